"""Conversation structure repair by iterative-deepening A*.

A conversation is legal when its roles' initials spell ``(s?(ua)+)?``.  Edits, in ASCII order: D delete a row (4), I insert
an empty user or assistant row anywhere (3), K keep (0), R change the role to user or assistant (3).  Blank and repeated
rows must be deleted; a truncated row that stays adds 3.  The answer is the cheapest list of edits, of equally cheap ones
the least in ASCII order.

Rows are taken by turn (nulls first), equal turns by role and text.  A row's first fault counts: blank (no character outside
``[\\x20\\x09-\\x0D]``), duplicate (role and text seen in an earlier row), truncated (last such character not ``[.!?]``).
The roles left to choose are always those that the pattern asks for next, so a state is (row, s/u/a seen last) and the
search tries D, I, K, R depth first under a bound on cost plus the cost that faults still force; a table remembers the
budgets with which a state has failed; the least cost above the bound is the next bound.  The first path that accepts is
the answer.

Conversations are read as a stream: Spark sorts them (spilling to disk), a task holds one run of ``RUN`` rows at a time.
For each run the search is made from every state that can be reached to every state at its end; what is carried along is,
per state, the cost, the edits and a SHA-256 that has taken in the rows repaired so far.  A prefix only matters by its cost
and state, so the parts join to the same answer; searches depend on initials and faults alone and are kept.  A conversation
of any length thus needs bounded memory but for its list of edits, which is a result.  Its rows pass one task, since a
SHA-256 is a chain.

Nulls: a null role or text counts as one space, a null conv_id as a conversation of its own, returned as null.  A role
without characters has no initial: it can't be kept.  Rows whose initial is another letter can't be kept either.  Repeated
rows are duplicates of each other.  Very long texts are only held one run at a time.  Other columns are not read, whatever
their names.  A table without rows gives a table without rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
RUN = 24                                     # rows searched at once
NAME = {"u": "user", "a": "assistant"}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}          # the role that a state asks for; '' is the start
ACCEPT = ("", "a")
RESULT = ("conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _moves(row: str | None, state: str) -> Iterator[tuple[str, int, bool, str]]:
    """(edit, cost, whether it uses the row, next state) in ASCII order; a row is its initial or '-' (any other), then its fault."""
    if row:
        yield "D", DELETE, True, state
    yield "I", INSERT, False, NEXT[state]
    if row and row[1] != "x":
        more = CUT if row[1] == "t" else 0
        if row[0] == NEXT[state] or (row[0] == "s" and state == ""):
            yield "K", more, True, row[0]
        yield "R", REROLE + more, True, NEXT[state]


@functools.lru_cache(200_000)
def search(rows: tuple[str, ...], start: str, goals: tuple[str, ...]) -> tuple[int, str, str]:
    """Cost, edits and last state of the cheapest way, ASCII-least, from ``start`` over all rows to one of ``goals``.

    A row is two characters: its initial (s, u, a or '-') and '.', 't' (truncated) or 'x' (must go)."""
    n = len(rows)
    forced = [0] * (n + 1)                                                # what the faults of the rows to come cost at least
    for i in range(n - 1, -1, -1):
        forced[i] = forced[i + 1] + {"x": DELETE, "t": min(CUT, DELETE), ".": 0}[rows[i][1]]

    def least(i, state):
        return forced[i] + (min(DELETE, INSERT, REROLE) if i == n and state not in goals else 0)

    bound = least(0, start)
    while True:
        failed: dict[tuple[int, str], int] = {}                           # state -> largest budget it has failed with
        over = None
        # depth-first, with the open moves of each state on a stack of its own
        way = [(0, start, 0, "", _moves(rows[0] if n else None, start))]
        if n == 0 and start in goals:
            return 0, "", start
        while way:
            i, state, spent, _, moves = way[-1]
            for edit, cost, used, then in moves:
                j, now = i + used, spent + cost
                want = now + least(j, then)
                if want > bound:
                    over = want if over is None else min(over, want)
                    continue
                if j == n and then in goals:
                    return now, "".join(w[3] for w in way) + edit, then
                if failed.get((j, then), -1) >= bound - now:
                    continue
                way.append((j, then, now, edit, _moves(rows[j] if j < n else None, then)))
                break
            else:
                failed[(i, state)] = max(failed.get((i, state), -1), bound - spent)
                way.pop()
        bound = over


class _Way:
    """A cheapest way to one state: cost, edits so far, and the hash of the rows repaired so far."""

    def __init__(self, cost=0, audit="", sha=None, empty=True):
        self.cost, self.audit, self.sha, self.empty = cost, audit, sha or hashlib.sha256(), empty

    def then(self, cost: int, audit: str, state: str, texts: list[tuple[str, str]]) -> "_Way":
        """This way, followed by edits over the rows (role, text)."""
        out = _Way(self.cost + cost, self.audit + audit, self.sha.copy(), self.empty)
        at = iter(texts)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(at)
            if edit != "D":
                if edit != "K":
                    role = NAME[NEXT[state]]
                state = role[0]
                out.sha.update((("" if out.empty else "\n") + role + ":" + text).encode())
                out.empty = False
        return out


class _Conversation:
    """What is known of the conversation that is being read."""

    def __init__(self, conv_id):
        self.conv_id, self.ways, self.run, self.last = conv_id, {"": _Way()}, [], None
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role, text, seen):
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += turn != self.turn
            self.turn = turn
        body = text.rstrip(" \t\n\v\f\r")
        fault = "."
        if not body:
            self.blank, fault = self.blank + 1, "x"
        elif seen:
            self.duplicate, fault = self.duplicate + 1, "x"
        elif body[-1] not in ".!?":
            self.truncated, fault = self.truncated + 1, "t"
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.run.append(((initial if initial in ("s", "u", "a") else "-") + fault, role, text))
        if len(self.run) >= RUN:
            self.close_run(None)

    def close_run(self, goals):
        rows, texts = tuple(r[0] for r in self.run), [r[1:] for r in self.run]
        best: dict[str, tuple] = {}
        for state, way in self.ways.items():
            for goal in [goals] if goals else [(s,) for s in NEXT]:
                if goal == ("",) and state != "" or goal == ("s",) and state != "s" and not any(r[0] == "s" and r[1] != "x" for r in rows) \
                        or goal == ("s",) and state not in ("", "s"):
                    continue                                              # the start and a leading s can't be come back to
                if goal == ("",) or (goal == ("s",) and state == "s"):    # only by deleting all rows
                    found = (DELETE * len(rows), "D" * len(rows), goal[0])
                else:
                    found = search(rows, state, goal)
                key = (way.cost + found[0], way.audit + found[1])
                if found[2] not in best or key < best[found[2]][:2]:
                    best[found[2]] = (*key, way, found, state)
        if goals:
            end = min(best.values(), key=lambda b: b[:2])
            best = {end[3][2]: end}
        self.ways = {s: b[2].then(b[3][0], b[3][1], b[4], texts) for s, b in best.items()}
        self.run = []

    def result(self):
        self.close_run(ACCEPT)
        (way,) = self.ways.values()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, way.cost, way.audit, way.sha.hexdigest())


def _repaired(schema: pa.Schema, size: int = 4096):
    def run(batches):
        now, out = None, []

        def written():
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(6)]
            for conv, turn, role, text, seen, alive in zip(*cols):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        out.append(now.result())
                    now = _Conversation(conv)
                if alive:
                    now.add(turn, role, text, seen)
            if len(out) >= size:
                yield written()
                out = []
        if now is not None:
            out.append(now.result())
        if out:
            yield written()
    return run


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """conv_id, faults, cost, edits and the hash of the repaired rows of each conversation in (conv_id, turn, role, text).

    Rows where ``present`` is false don't belong to the conversation, but it gets a result even if it has no others."""
    alive = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    filled = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    rows = turns.select(turns["conv_id"].alias("c"), turns["turn"].cast("long").alias("t"), filled("role").alias("r"), filled("text").alias("x"), alive.alias("p"))
    rows = rows.select("c", F.when(F.col("p"), F.col("t")).alias("t"), F.when(F.col("p"), F.col("r")).alias("r"), F.when(F.col("p"), F.col("x")).alias("x"), "p")
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = rows.repartition(n, "c")                                       # the window and the sort below need no further shuffle
    order = [F.asc_nulls_first("t"), "r", "x"]
    seen = F.row_number().over(Window.partitionBy("c", "p", "r", "x").orderBy(F.asc_nulls_first("t"))) > 1
    rows = rows.withColumn("seen", seen).sortWithinPartitions("c", *order, "seen")
    kind = turns.schema["conv_id"].dataType
    sql = RESULT.format(kind.simpleString())
    schema = pa.schema([pa.field(x.split(" ")[0], _arrow(kind) if k == 0 else pa.int64() if x.split(" ")[1] == "long" else pa.string())
                        for k, x in enumerate(sql.split(", "))])
    return rows.select("c", "t", "r", "x", "seen", "p").mapInArrow(_repaired(schema), sql)


def damage(turns: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with the faults that crc32(``conv_id:turn``) mod 20 puts in, nulls as one space;
    ``gone`` marks rows that it drops."""
    filled = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    how = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = turns.select(turns["conv_id"], turns["turn"], filled("role").alias("role"), filled("text").alias("text"), how.alias("how"))
    rows = rows.withColumns({"text": F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
                             "role": F.when(F.col("how") == 4, "user").otherwise(F.col("role")),
                             "copy": F.explode(F.when(F.col("how") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))})
    return rows.select("conv_id", "turn", "role", "text", (F.col("how") == 0).alias("gone"))


def damage_and_repair(turns: DataFrame) -> DataFrame:
    damaged = damage(turns)
    return repair(damaged, ~F.col("gone"))


#: Dynamic programming over (row, state) in place of the search; the checksum is worked out bit by bit.
ORACLE = r"""
WITH RECURSIVE
tbl AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
        FROM range(256) r(i)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
how AS (SELECT k, xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT),
                                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS how
        FROM (SELECT DISTINCT k FROM keyed), tbl),
damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM keyed JOIN how USING (k), unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(c)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, rtrim(text, E' \t\n\x0b\f\r') AS body, role[1] AS ini FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)),
faulty AS (
  SELECT *, body = '' AS blank, body <> '' AND seen AS duplicate, body <> '' AND NOT seen AND NOT regexp_matches(body, '[.!?]$') AS truncated,
         lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM ordered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faulty GROUP BY conv_id),
states(q, want) AS (VALUES ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
moves AS (   -- a row's edit, after an insertion or none
  SELECT f.conv_id, f.i, s.q, ins, op, CASE op WHEN 'D' THEN s2.q WHEN 'K' THEN f.ini ELSE s2.want END AS q2,
         ins * 3 + CASE op WHEN 'D' THEN 4 ELSE CASE op WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN f.truncated THEN 3 ELSE 0 END END AS cost,
         CASE WHEN ins = 1 THEN 'I' ELSE '' END || op AS edits,
         (CASE WHEN ins = 1 THEN chr(10) || CASE s.want WHEN 'u' THEN 'user:' ELSE 'assistant:' END ELSE '' END)
         || CASE op WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text
            ELSE chr(10) || CASE s2.want WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text END AS body
  FROM faulty f, states s, (VALUES (0), (1)) AS inserted(ins), (VALUES ('D'), ('K'), ('R')) AS ops(op), states s2
  WHERE s2.q = CASE WHEN ins = 1 THEN s.want ELSE s.q END
    AND (op = 'D' OR NOT (f.blank OR f.duplicate)) AND (op <> 'K' OR f.ini = s2.want OR (f.ini = 's' AND s2.q = ''))),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS q, 0::BIGINT AS cost, '' AS edits, '' AS body FROM counts
  UNION ALL
  SELECT conv_id, b.i, b.q, b.w.cost, b.w.edits, b.w.body FROM (
    SELECT w.conv_id, m.i, m.q2 AS q, min({'cost': (w.cost + m.cost)::BIGINT, 'edits': w.edits || m.edits, 'body': w.body || m.body}) AS w
    FROM ways w JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 AND m.q = w.q GROUP BY 1, 2, 3) b),
done AS (
  SELECT w.conv_id, min({'cost': CASE WHEN q IN ('', 'a') THEN cost ELSE cost + 3 END, 'edits': CASE WHEN q IN ('', 'a') THEN edits ELSE edits || 'I' END,
                         'body': CASE WHEN q IN ('', 'a') THEN body ELSE body || chr(10) || 'assistant:' END}) AS w
  FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i WHERE q <> 's' GROUP BY w.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(d.w.cost, 0) AS cost, coalesce(d.w.edits, '') AS audit,
       sha256(coalesce(substr(d.w.body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM a.conv_id
"""
