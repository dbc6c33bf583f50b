"""Conversation repair by Knuth's lightest derivations.

An item says: so many rows are consumed and the kept roles stand at this point
of the pattern ``(s?(ua)+)?``.  Its weight is (cost, audit): what the edits cost
and their initials in order.  A deduction consumes a row (keep, rerole, delete)
or inserts a turn; it adds to the cost and appends a letter, so its conclusion
weighs more than its premise and order is kept (of two audits of one item at
equal cost neither begins the other, as an insertion costs).  The agenda pops
items by weight; what is popped is final, and the first goal is the answer.

A conversation of up to ``STRETCH`` rows is one group of a task.  A longer one
is cut into stretches: each gives its lightest derivations from every state to
every state, ``FOLD`` stretches at a time are put together by the same agenda
(their derivations are the deductions), level by level, and the states in which
the answer passes from one stretch to the next tell which of them to apply.  Only
the hash of the result, which is one hash of all its bytes, is taken in one task;
the rows stream through it.

Defined cases: rows of a conversation are taken by turn, nulls first, then role,
then text; a null conv_id is a conversation; a null role or text is one space; a
role's initial is its first character, and only ``s``, ``u`` and ``a`` can be
kept; equal rows are rows of their own, of which the later are duplicates.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import number_sorted, table
from .scratch import settle

#: Rows of a conversation that are derived together, and stretches that are put together.
STRETCH, FOLD = 512, 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after s, after u, after a. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
_ROLE = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_SPACE = " \t\n\v\f\r"


def fault(text: str, again: bool) -> str | None:
    """The first fault of a row; ``again``: whether its role and text were seen earlier."""
    last = text.rstrip(_SPACE)[-1:]
    return BLANK if not last else DUPLICATE if again else None if last in ".!?" else CUT


def deductions(initial: str, what: str | None) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, letter) of the edits that consume a row."""
    out = [(q, q, DELETE, "D") for q in _ROLE]
    if what in (BLANK, DUPLICATE):
        return out
    more = TRUNCATED if what == CUT else 0
    out += [(q, to, KEEP + more, "K") for (q, r), to in _KEPT.items() if r == initial]
    return out + [(q, to, REROLE + more, "R") for q, (_, to) in _ROLE.items()]


def lightest(steps: list[list[tuple]], entry: int, insert: bool = True, goals: tuple[int, ...] | None = None) -> dict[int, tuple]:
    """The lightest derivation of each state after all steps, as (cost, audit, payload).

    ``steps``: for each position its deductions (state, next state, cost, audit
    and, where there is one, a payload of which the last parts are strings that
    are strung together but not compared).  With ``goals`` the agenda ends at
    the first of them.
    """
    by = [{} for _ in steps]
    for have, step in zip(by, steps, strict=True):
        for q, to, cost, audit, *more in step:
            have.setdefault(q, []).append((to, cost, audit, more[0] if more else ""))
    n, done, found = len(steps), set(), {}
    agenda = [(0, "", 0, entry, "")]
    while agenda:
        cost, audit, at, q, path = heappop(agenda)
        if (at, q) in done:
            continue
        done.add((at, q))
        if at == n:
            found[q] = (cost, audit, path)
            if goals and q in goals:
                return {q: found[q]}
        else:
            for to, more, letters, part in by[at].get(q, ()):
                if (at + 1, to) not in done:
                    heappush(agenda, (cost + more, audit + letters, at + 1, to, path + part))
        if insert and (at, _ROLE[q][1]) not in done:
            heappush(agenda, (cost + INSERT, audit + "I", at, _ROLE[q][1], path))
    return found


def applied(rows: list[tuple[str, str]], audit: str, state: int):
    """(role, text) of the repaired turns; ``state``: where the pattern stands before."""
    k = 0
    for letter in audit:
        if letter != "I":
            role, text = rows[k]
            k += 1
        if letter == "D":
            continue
        if letter == "K":
            state = _KEPT[state, role[:1]]
        else:
            role, state = _ROLE[state]
        yield role, "" if letter == "I" else text


def _grouped(batches, keys: int, columns: int):
    """Sorted batches to (key, rows) of one group after the other, at most one group at a time."""
    held, last = [], None
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(columns)]
        for row in zip(*cols, strict=True):
            key = row[:keys]
            if last is not None and key != last:
                yield last, held
                held = []
            last = key
            held.append(row[keys:])
    if held:
        yield last, held


def _batches(rows, fields: list[tuple[str, pa.DataType]], size: int = 2000):
    """Tuples to batches, also ended by the bytes of their texts."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or weight > 1 << 24:
            yield _batch(held, fields)
            held, weight = [], 0
    if held:
        yield _batch(held, fields)


def _batch(rows, fields):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


_LONG, _TEXT = pa.int64(), pa.string()
_FAULTS = ["blank", "duplicate", "truncated", "illegal"]
_DIGEST = [("conv_id", _LONG), *[(c, _LONG) for c in _FAULTS], ("cost", _LONG), ("audit", _TEXT), ("repaired_sha256", _TEXT)]
_TURNS = [("conv_id", _LONG), ("part", _LONG), ("place", _LONG), ("role", _TEXT), ("text", _TEXT)]
_FOUND = [("conv_id", _LONG), ("stretch", _LONG), ("p", _LONG), ("q", _LONG), ("cost", _LONG), ("audit", _TEXT), ("path", _TEXT)]
_COUNTS = [("conv_id", _LONG), ("stretch", _LONG), *[(c, _LONG) for c in _FAULTS], ("first", _TEXT), ("last", _TEXT)]


def _kind(fields) -> str:
    return ", ".join(f"{n} {'long' if t == _LONG else 'string'}" for n, t in fields)


def _counts(rows: list[tuple[str, str]], faults: list[str | None]) -> list[int]:
    initials = [role[:1] for role, _ in rows]
    return [*[faults.count(x) for x in (BLANK, DUPLICATE, CUT)], sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))]


def _whole(turns: bool):
    """Rows sorted by conversation and place to a row for each conversation, or to its repaired turns."""

    def run(batches):
        def made():
            for (conv,), rows in _grouped(batches, 1, 3):
                seen = set()
                faults = [fault(text, (role, text) in seen or seen.add((role, text)) is not None) for role, text in rows]
                steps = [deductions(role[:1], what) for (role, _), what in zip(rows, faults, strict=True)]
                ((cost, audit, _),) = lightest(steps, START, goals=ENDS).values()
                out = applied(rows, audit, START)
                if turns:
                    yield from ((conv, 0, k, role, text) for k, (role, text) in enumerate(out))
                else:
                    yield conv, *_counts(rows, faults), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode("utf-8", "surrogatepass")).hexdigest()

        yield from _batches(made(), _TURNS if turns else _DIGEST)

    return run


def _stretches(counts: bool):
    """Rows and marks of duplicates by (conversation, stretch) to the counts of a stretch, or to its lightest derivations."""

    def run(batches):
        def made():
            for (conv, stretch), rows in _grouped(batches, 2, 6):
                again = {pos for mark, pos, _, _ in rows if mark == 0}
                turns = [(role, text, pos in again) for mark, pos, role, text in rows if mark]
                faults = [fault(text, twice) for _, text, twice in turns]
                if counts:
                    yield conv, stretch, *_counts([t[:2] for t in turns], faults), turns[0][0][:1], turns[-1][0][:1]
                    continue
                steps = [deductions(role[:1], what) for (role, _, _), what in zip(turns, faults, strict=True)]
                for p in _ROLE if stretch else (START,):
                    for q, (cost, audit, _) in lightest(steps, p).items():
                        yield conv, stretch, p, q, cost, audit, str(p)

        yield from _batches(made(), _COUNTS if counts else _FOUND)

    return run


def _folded(batches):
    """Derivations of FOLD stretches, by (conversation, group), to those of all of them."""

    def made():
        for (conv, group), rows in _grouped(batches, 2, 8):
            steps: dict[int, list[tuple]] = {}
            for stretch, p, q, cost, audit, path in rows:
                steps.setdefault(stretch, []).append((p, q, cost, audit, path))
            for p in _ROLE if group else (START,):
                for q, (cost, audit, path) in lightest([steps[k] for k in sorted(steps)], p, insert=False).items():
                    yield conv, group, p, q, cost, audit, path

    yield from _batches(made(), _FOUND)


def _rendered(turns: bool):
    """Rows and chosen derivations by (conversation, stretch) to the hash of each conversation, or to its repaired turns; one stretch is held."""

    def run(batches):
        def made():
            last, digest, some = None, None, False
            for (conv, stretch), rows in _grouped(batches, 2, 6):
                if not turns and (conv,) != last:
                    if last is not None:
                        yield *last, digest.hexdigest()
                    last, digest, some = (conv,), hashlib.sha256(), False
                state, audit = next((pos, text) for mark, pos, _, text in rows if mark == 0)
                for k, (role, text) in enumerate(applied([(role, text) for mark, _, role, text in rows if mark], audit, state)):
                    if turns:
                        yield conv, stretch, k, role, text
                    else:
                        digest.update(("\n" * some + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                        some = True
            if last is not None:
                yield *last, digest.hexdigest()

        yield from _batches(made(), _TURNS if turns else [("conv_id", _LONG), ("repaired_sha256", _TEXT)])

    return run


def _long(rows: DataFrame, turns: bool, stretch: int, fold: int) -> DataFrame:
    """What ``_whole`` gives, for conversations that are cut into stretches."""
    numbered = number_sorted(settle(rows), ["conv_id"], ["turn", "role", "text"], "pos").withColumn("stretch", F.floor(F.col("pos") / stretch).cast("long"))
    numbered = settle(numbered.select("conv_id", "stretch", F.lit(1).alias("mark"), "pos", "role", "text"))
    firsts = numbered.groupBy("conv_id", "role", "text").agg(F.min("pos").alias("pos")).select(F.col("conv_id").alias("c"), F.col("pos").alias("f"))
    none = F.lit(None).cast("string")
    again = numbered.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("f")), "left_anti").select("conv_id", "stretch", F.lit(0).alias("mark"), "pos", none.alias("role"), none.alias("text"))
    parts = settle(numbered.unionByName(again).repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "mark", "pos"))
    # a table is read in splits; what belongs together is dealt again, of the same partitioning
    dealt = lambda df, keys, by: df.repartition(*keys).sortWithinPartitions(*keys, *by)
    found = settle(dealt(parts, ["conv_id", "stretch"], ["mark", "pos"]).mapInArrow(_stretches(False), _kind(_FOUND)))

    level, top = found, found.agg(F.max("stretch")).first()[0] or 0
    while top:
        group = F.floor(F.col("stretch") / fold).cast("long")
        rows_of = level.select("conv_id", group.alias("group"), "stretch", "p", "q", "cost", "audit", "path")
        level, top = settle(dealt(rows_of, ["conv_id", "group"], ["stretch"]).mapInArrow(_folded, _kind(_FOUND))), top // fold
    best = level.filter(F.col("q").isin(*ENDS)).groupBy("conv_id").agg(F.min(F.struct("cost", "audit", "q", "path")).alias("b")).select("conv_id", "b.*")
    best = settle(best)

    states = best.select("conv_id", F.posexplode(F.split(F.concat("path", F.col("q").cast("string")), "")).alias("at", "state"), F.length("path").alias("n"))
    here = states.select(F.col("conv_id").alias("c"), F.col("at").cast("long").alias("s"), F.col("state").cast("long").alias("from")).filter(F.col("at") < F.col("n"))
    after = states.select(F.col("conv_id").alias("c2"), (F.col("at") - 1).cast("long").alias("s2"), F.col("state").cast("long").alias("to")).filter("s2 >= 0")
    passed = here.join(after, F.col("c").eqNullSafe(F.col("c2")) & (F.col("s") == F.col("s2"))).select("c", "s", "from", "to")
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s")) & (F.col("p") == F.col("from")) & (F.col("q") == F.col("to"))
    chosen = found.join(passed, on).select("conv_id", "stretch", F.lit(0).alias("mark"), F.col("p").alias("pos"), none.alias("role"), F.col("audit").alias("text"))
    stream = numbered.unionByName(chosen)
    if turns:
        return dealt(stream, ["conv_id", "stretch"], ["mark", "pos"]).mapInArrow(_rendered(True), _kind(_TURNS))
    hashes = stream.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "mark", "pos").mapInArrow(_rendered(False), "conv_id long, repaired_sha256 string")

    counts = settle(dealt(parts, ["conv_id", "stretch"], ["mark", "pos"]).mapInArrow(_stretches(True), _kind(_COUNTS)))
    pair = F.concat(F.lag("last").over(Window.partitionBy("conv_id").orderBy("stretch")), "first")
    counts = counts.withColumn("illegal", F.col("illegal") + F.when(pair.isNotNull() & ~pair.isin(*LEGAL), 1).otherwise(0)).groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in _FAULTS])
    same = lambda a, b: a.join(b.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return same(same(counts, best.select("conv_id", "cost", "audit")), hashes)


def _prepared(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def _solved(rows: DataFrame, turns: bool, stretch: int, fold: int) -> DataFrame:
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > stretch)
    large = settle(sizes.select(F.col("conv_id").alias("c")))
    some, same = not large.isEmpty(), F.col("conv_id").eqNullSafe(F.col("c"))
    small = rows.join(large, same, "left_anti") if some else rows
    out = small.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_whole(turns), _kind(_TURNS if turns else _DIGEST))
    return out.unionByName(_long(rows.join(large, same, "left_semi"), turns, stretch, fold)) if some else out


def repair_digest(conversations: DataFrame, stretch: int = STRETCH, fold: int = FOLD) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation that has rows."""
    rows = _prepared(conversations)
    gaps = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")).withColumnRenamed("conv_id", "c")
    solved = _solved(rows, False, stretch, fold)
    return solved.join(gaps, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "gaps", *_FAULTS, "cost", "audit", "repaired_sha256")


def repaired_turns(conversations: DataFrame, stretch: int = STRETCH, fold: int = FOLD) -> DataFrame:
    """conv_id, part, place, role and text of the repaired conversations, whose turns are in order of (part, place)."""
    return _solved(_prepared(conversations), True, stretch, fold)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults: by a checksum of conversation and turn rows go, lose their text or its stops, come twice or become the user's."""
    rows = _prepared(conversations)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = rows.withColumn("what", what).filter("what <> 0")
    rows = rows.withColumn("text", F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("what") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    done = repair_digest(damaged(conversations)).withColumnRenamed("conv_id", "c")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *_FAULTS, "cost")]
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: Every state after every row, with up to two insertions before each row and at the end.
OP13_SQL = r"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
sums AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(1 AS BIGINT), 2, 3, 4, 5, 6, 7, 8]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS what FROM given),
hurt AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN what = 3 THEN [0, 1] ELSE [0] END) AS copy FROM sums WHERE what <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM hurt),
faulty AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS what,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1] AS pair FROM ordered),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE what = 'blank') AS blank, count(*) FILTER (WHERE what = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE what = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM faulty GROUP BY conv_id),
ins(a, b, cost, letters, put) AS (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:']),
  (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:']), (2, 2, 10, 'II', ['assistant:', 'user:']), (3, 3, 10, 'II', ['user:', 'assistant:'])),
edits(a, b, letter, initial, cost, named) AS (VALUES (0, 0, 'D', '', 2, ''), (1, 1, 'D', '', 2, ''), (2, 2, 'D', '', 2, ''), (3, 3, 'D', '', 2, ''), (0, 1, 'K', 's', 0, ''), (0, 2, 'K', 'u', 0, ''), (1, 2, 'K', 'u', 0, ''), (2, 3, 'K', 'a', 0, ''), (3, 2, 'K', 'u', 0, ''),
  (0, 2, 'R', '', 1, 'user'), (1, 2, 'R', '', 1, 'user'), (2, 3, 'R', '', 1, 'assistant'), (3, 2, 'R', '', 1, 'user')),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS put FROM counts
  UNION ALL
  SELECT conv_id, pos, state, cost, audit, put FROM (
    SELECT w.conv_id, f.pos, e.b AS state, w.cost + i.cost + e.cost + CASE WHEN e.letter <> 'D' AND f.what = 'truncated' THEN 5 ELSE 0 END AS cost, w.audit || i.letters || e.letter AS audit,
      list_concat(w.put, list_concat(CAST(i.put AS VARCHAR[]), CASE WHEN e.letter = 'D' THEN CAST([] AS VARCHAR[]) ELSE [CASE WHEN e.letter = 'K' THEN f.role ELSE e.named END || ':' || f.text] END)) AS put
    FROM best w JOIN faulty f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = w.pos + 1 JOIN ins i ON i.a = w.state JOIN edits e ON e.a = i.b
    WHERE (e.letter = 'D' OR f.what NOT IN ('blank', 'duplicate')) AND (e.letter <> 'K' OR e.initial = f.role[1]))
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
ended AS (SELECT b.conv_id, b.cost + i.cost AS cost, b.audit || i.letters AS audit, list_concat(b.put, CAST(i.put AS VARCHAR[])) AS put
  FROM best b JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.pos = c.n JOIN ins i ON i.a = b.state AND i.b IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + i.cost, b.audit || i.letters) = 1)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(put, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""
