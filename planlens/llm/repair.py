"""Repair of conversation structure: the cheapest edits that bring the roles of a conversation into ``(s?(ua)+)?``.

A conversation becomes a signature, one letter a row, of role and fault.  Distinct signatures, sorted by their reverse, share
their ends: a node of the suffix-shared automaton is one distinct end, visited once for all conversations that have it.
Each node holds, for every state of the grammar, the cost to go and the first edit of the best audit from there; ends whose
tables differ by a constant alone are one and the same entry, so a table is computed once for a letter and an entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlens.llm.common import WORD, crc32_sql, spread, text_batches, written

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States: nothing yet, after a system row, after a user row, after an assistant row.  The state that a rerole or an insert leads to.
FORCED = (2, 2, 3, 2)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {2: "user", 3: "assistant"}
PAIRS = frozenset(("su", "ua", "au"))
#: A row that has to go; other rows are their role's initial (``o``: any other role), in upper case if truncated.
GONE, OTHER = "x", "o"
STATS = "gaps long, blank long, duplicate long, truncated long, illegal long"


class Node(NamedTuple):
    """Per state the cost to go above the least one, and the first edit; ``""`` where nothing is left to do."""
    over: tuple[int, ...]
    edit: tuple[str, ...]


def with_inserts(cost: list[int], edit: list[str]) -> tuple[int, Node]:
    """The least cost and the node, after inserts have been tried; a tie goes to the lesser letter.

    From a state no two edits have the same letter, so the first letters decide every tie between audits.
    """
    for _ in FORCED:
        for g, to in enumerate(FORCED):
            if (new := (cost[to] + INSERT, "I")) < (cost[g], edit[g]):
                cost[g], edit[g] = new
    least = min(cost)
    return least, Node(tuple(c - least for c in cost), tuple(edit))


def end_node() -> tuple[int, Node]:
    never = 1 << 40
    return with_inserts([0, never, never, 0], ["", "~", "~", ""])


def node_before(letter: str, after: Node) -> tuple[int, Node]:
    """What the row ``letter`` adds in front of an end."""
    cost, edit = [], []
    role, extra = letter.lower(), TRUNCATED * letter.isupper()
    for g in range(len(FORCED)):
        options = [(after.over[g] + DELETE, "D")]
        if letter != GONE:
            options.append((after.over[FORCED[g]] + REROLE + extra, "R"))
            if (to := KEPT.get((g, role))) is not None:
                options.append((after.over[to] + extra, "K"))
        best = min(options)
        cost.append(best[0])
        edit.append(best[1])
    return with_inserts(cost, edit)


class Automaton:
    """The ends of signatures met in the order of their reverse: the path to the current one, and all distinct entries."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, Node], tuple[int, Node]] = {}
        least, node = end_node()
        self.least, self.nodes, self.back = [least], [node], ""

    def read(self, signature: str) -> tuple[int, str]:
        """Cost and audit of a signature; what it shares with the end of the one before is not computed again."""
        back = signature[::-1]
        same = len(commonprefix([back, self.back]))
        del self.least[same + 1:], self.nodes[same + 1:]
        for letter in back[same:]:
            key = letter, self.nodes[-1]
            if key not in self.known:
                self.known[key] = node_before(*key)
            added, node = self.known[key]
            self.least.append(self.least[-1] + added)
            self.nodes.append(node)
        self.back = back
        return self.least[-1] + self.nodes[-1].over[0], self.audit(signature)

    def audit(self, signature: str) -> str:
        out, state, at = [], 0, 0
        while edit := self.nodes[len(signature) - at].edit[state]:
            out.append(edit)
            if edit == "K":
                state = KEPT[state, signature[at].lower()]
            elif edit != "D":
                state = FORCED[state]
            at += edit != "I"
        return "".join(out)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, live, turn, role, text): the rows after damage; a dropped one stays as not live."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), (fate != 0).alias("live"), F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(text("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Whole conversations in one task, sorted; the task streams them and holds none.  Rows of one turn stand by role and text."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "text")


def signed(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of each conversation in ``damaged`` rows."""
    again = F.row_number().over(Window.partitionBy("conv_id", "live", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = (F.when(~F.col("text").rlike(WORD), "blank").when(F.col("again"), "duplicate")
             .when(~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), "truncated").otherwise(""))
    sorted_rows = (rows.repartition("conv_id").withColumn("again", again)
                   .sortWithinPartitions("conv_id", "live", F.col("turn").asc_nulls_first(), "role", "text", "again")
                   .select("conv_id", "live", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv: object = run  # no conversation yet
        letters: list[str] = []
        count: dict[str, int] = {}
        first = last = None
        turns = illegal = 0
        before = ""

        def close() -> None:
            gaps = last - first + 1 - turns if first is not None else 0
            done.append((conv, "".join(letters), gaps, *(count.get(x, 0) for x in ("blank", "duplicate", "truncated")), illegal))

        for b in batches:
            for c, live, turn, initial, fault in zip(*(col.to_pylist() for col in b.columns)):
                if conv is run or c != conv:
                    if conv is not run:
                        close()
                    conv, letters, count, first, last, turns, illegal, before = c, [], {}, None, None, 0, 0, ""
                if not live:
                    continue
                if letters and before + initial not in PAIRS:
                    illegal += 1
                if turn is not None and turn != last:
                    first, last, turns = (turn if first is None else first), turn, turns + 1
                count[fault] = count.get(fault, 0) + 1
                kind = initial if initial in ("s", "u", "a") else OTHER
                letters.append(GONE if fault in ("blank", "duplicate") else kind.upper() if fault else kind)
                before = initial
            yield rows_of(done, SIGNED)
            done = []
        if conv is not run:
            close()
        yield rows_of(done, SIGNED)

    return sorted_rows.mapInArrow(run, f"conv_id long, signature string, {STATS}")


SIGNED = pa.schema([("conv_id", pa.int64()), ("signature", pa.string()), *((x.split()[0], pa.int64()) for x in STATS.split(", "))])
DIGESTS = pa.schema([("conv_id", pa.int64()), *((x.split()[0], pa.int64()) for x in STATS.split(", ")), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature, by an automaton for each range of reversed signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for b in batches:
            found = [automaton.read(s) for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["signature", "cost", "audit"])

    return (signatures.select("signature").distinct().withColumn("back", F.reverse("signature")).repartitionByRange("back").sortWithinPartitions("back")
            .select("signature").mapInArrow(run, "signature string, cost long, audit string"))


class Lines:
    """Walks an audit along the rows of its conversation and gives the lines of the repaired one."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[str]:
        """The empty rows due at this point."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, FORCED[self.state]
            yield f"{ROLE[self.state]}:"

    def row(self, role: str, text: str) -> Iterator[str]:
        """The lines up to and with the next row of the conversation."""
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = KEPT[self.state, role[:1]]
            yield f"{role}:{text}"
        elif edit == "R":
            self.state = FORCED[self.state]
            yield f"{ROLE[self.state]}:{text}"


def digests(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The result of each head, its conversation's repaired lines hashed as they stream by behind it."""
    names = [f.name for f in DIGESTS][1:-1]
    nothing = {f.name: F.lit(None).cast("string" if f.name == "audit" else "long") for f in DIGESTS if f.name in names}
    text_rows = rows.filter("live").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", *[c.alias(n) for n, c in nothing.items()])
    head_rows = heads.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), *names)
    text_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        head: tuple | None = None
        lines, hashed, empty = Lines(""), sha256(), True

        def add(found: Iterator[str]) -> None:
            nonlocal empty
            for line in found:
                hashed.update(line.encode() if empty else b"\n" + line.encode())
                empty = False

        def close() -> None:
            add(lines.inserted())
            done.append((*head, hashed.hexdigest()))  # type: ignore[misc]

        for b in batches:
            conv, kind, role, text = (b.column(i).to_pylist() for i in (0, 1, 3, 4))
            stats = [b.column(i) for i in range(5, 5 + len(names))]
            for i, k in enumerate(kind):
                if k == 0:
                    if head is not None:
                        close()
                    head = (conv[i], *(s[i].as_py() for s in stats))
                    lines, hashed, empty = Lines(head[-1]), sha256(), True
                else:
                    add(lines.row(role[i], text[i]))
            yield rows_of(done, DIGESTS)
            done = []
        if head is not None:
            close()
        yield rows_of(done, DIGESTS)

    return in_order(head_rows.unionByName(text_rows), "kind").mapInArrow(run, f"conv_id long, {STATS}, cost long, audit string, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    A null role or text counts as one space, so a null text is blank and a null role has to be changed or deleted; rows
    without ``conv_id`` form one conversation.  Rows without ``turn`` come first and are left out of the gaps; rows of one
    turn stand in the order of role and text.  A conversation whose rows are all dropped has zeros, an empty audit and the
    digest of an empty text; a table without rows gives none.  Other columns play no part.  A conversation is streamed: its
    digest needs its rows in one task one after the other, which holds of them a letter each and sorts on disk.
    """
    rows = damaged(conversations)
    heads = written(signed(rows), "signatures")
    answers = written(solved(heads), "audits")
    return digests(rows, heads.join(spread(answers), "signature"))


def sql() -> str:
    """The same in SQL: the tables of costs walk back along the rows of a conversation as text, cost before audit."""
    blanks = "[\\x20\\x09-\\x0D]"
    cost = lambda c, letter, v: f"printf('%09d', substr({v}, 1, 9)::INT + {c}) || '{letter}' || substr({v}, 10)"
    step = []
    for g in range(4):
        options = [cost(DELETE, "D", f"p.v{g}")]
        extra = f"CASE WHEN f.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END"
        free = "f.fault IN ('', 'truncated')"
        options.append(f"CASE WHEN {free} THEN {cost(f'{REROLE} + {extra}', 'R', f'p.v{FORCED[g]}')} END")
        options += [f"CASE WHEN {free} AND f.initial = '{r}' THEN {cost(extra, 'K', f'p.v{to}')} END" for (s, r), to in KEPT.items() if s == g]
        step.append(f"least({', '.join(options)}) AS w{g}")
    insert = lambda v: cost(INSERT, "I", v)
    two, three = f"least(w2, {insert('w3')})", f"least(w3, {insert('w2')})"
    closed = f"least(w0, {insert(two)}) AS v0, least(w1, {insert(two)}) AS v1, {two} AS v2, {three} AS v3"
    forced = "CASE WHEN q.state = 2 THEN 3 ELSE 2 END"
    kept = "CASE WHEN f.initial = 's' THEN 1 WHEN f.initial = 'u' THEN 2 ELSE 3 END"
    return f"""WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations),
convs AS (SELECT row_number() OVER () AS c, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
live AS (
  SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE k <> 0) d JOIN convs ON convs.conv_id IS NOT DISTINCT FROM d.conv_id),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM live),
o AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS seen FROM n),
f AS MATERIALIZED (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '{WORD}') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?]{blanks}*$') THEN 'truncated' ELSE '' END AS fault FROM o),
stats AS (
  SELECT convs.c, convs.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(i) AS n
  FROM convs LEFT JOIN f USING (c) GROUP BY convs.c, convs.conv_id),
v AS (
  SELECT c, n + 1 AS i, '000000000' AS v0, '000000010II' AS v1, '000000005I' AS v2, '000000000' AS v3 FROM stats
  UNION ALL
  SELECT c, i, {closed} FROM (SELECT p.c, f.i, {', '.join(step)} FROM v p JOIN f ON f.c = p.c AND f.i = p.i - 1)),
best AS MATERIALIZED (SELECT stats.*, substr(v0, 1, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM stats JOIN v ON v.c = stats.c AND v.i = 1),
walk AS (
  SELECT c, 1::BIGINT AS spot, 1::BIGINT AS i, 0 AS state, NULL::VARCHAR AS line, audit FROM best
  UNION ALL
  SELECT q.c, q.spot + 1, CASE WHEN q.e = 'I' THEN q.i ELSE q.i + 1 END, CASE q.e WHEN 'D' THEN q.state WHEN 'K' THEN {kept} ELSE {forced} END,
    CASE q.e WHEN 'K' THEN f.role || ':' || f.text WHEN 'D' THEN NULL
      ELSE CASE WHEN q.state = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN q.e = 'R' THEN f.text ELSE '' END END, q.audit
  FROM (SELECT *, substr(audit, spot, 1) AS e FROM walk WHERE spot <= length(audit)) q LEFT JOIN f ON f.c = q.c AND f.i = q.i)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM best LEFT JOIN (SELECT c, string_agg(line, chr(10) ORDER BY spot) AS text FROM walk GROUP BY c) USING (c)"""
