"""Repair of conversations: the cheapest edits that bring roles into the order (system? (user assistant)+)?, and what they leave.

A row is told by its signature, one letter for its role's initial and first fault. What the cheapest edits from a row on are depends on
the signatures from there to the end and on the grammar's state alone, so conversations share it by suffix: an automaton whose nodes are
the distinct suffixes of all distinct signatures, built from the end, holds for each node and state the cost to go and the first edit,
which leads to the next node's. Signatures sorted by their reverse meet nodes in the order of a walk: a stack holds the current one's
nodes, the next one shares those of the common suffix, and each node is made once in a range of sorted signatures. Where edits cost the
same, the letters that begin them differ, so the smallest letter alone decides, and suffixes are never compared or copied.

Rows are exchanged twice: without texts, to signatures, and with texts, to meet their conversation's edits. Both times a conversation
streams through its task sorted, held as a letter a row, and never as a group. The digest of a conversation's text is sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playwatch.llm.common import written

NOT_BLANK = "[^\\x20\\x09-\\x0D]"

#: Costs of edits; a kept or rewritten row that is truncated costs TRUNCATED more.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: States of the grammar by the initial that came last: none, system, user, assistant. Each row: initial -> next state.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state after the one role that may be put in each state.
PUT = (2, 2, 3, 2)
ROLE = ("", "system", "user", "assistant")
#: Signature letters: a row that must go; else its initial (x: any other), in capitals where its text is truncated.
GONE = "-"


class Node:
    """A suffix of signatures: by state, the cost to go and the first edit. ``after`` is the suffix without its first row."""

    __slots__ = ("after", "cost", "edit", "letter")

    def __init__(self, letter: str, after: Node | None):
        self.letter, self.after = letter, after
        best: list[tuple[float, str]] = []
        for state in range(4):
            if after is None:
                options = [(0.0 if state in (0, 3) else float("inf"), "")]
            else:
                options = [(DELETE + after.cost[state], "D")]
                if letter != GONE:
                    extra = TRUNCATED if letter.isupper() else 0
                    to = NEXT[state].get(letter.lower())
                    if to is not None:
                        options.append((extra + after.cost[to], "K"))
                    options.append((extra + REROLE + after.cost[PUT[state]], "R"))
            best.append(min(options))
        # a row put in leads to another state of the same suffix; of three in a row one would be too many
        for _ in range(3):
            best = [min(best[state], (INSERT + best[PUT[state]][0], "I")) for state in range(4)]
        self.cost, self.edit = [c for c, _ in best], [e for _, e in best]

    def edits(self) -> tuple[int, str]:
        """The cost and the edits' initials from the first state on."""
        node, state, out = self, 0, []
        while True:
            edit = node.edit[state]
            if not edit:
                return int(self.cost[0]), "".join(out)
            out.append(edit)
            if edit == "I":
                state = PUT[state]
                continue
            if edit != "D":
                state = NEXT[state][node.letter.lower()] if edit == "K" else PUT[state]
            node = node.after


class Suffixes:
    """The nodes of signatures met in ascending order of their reverse: those of the suffix that one shares with the one before are kept."""

    def __init__(self):
        self.stack, self.last = [Node("", None)], ""

    def node(self, reverse: str) -> Node:
        common = 0
        for a, b in zip(reverse, self.last, strict=False):
            if a != b:
                break
            common += 1
        del self.stack[common + 1 :]
        for letter in reverse[common:]:
            self.stack.append(Node(letter, self.stack[-1]))
        self.last = reverse
        return self.stack[-1]


def signature_edits(signatures: DataFrame) -> DataFrame:
    """signature, cost and audit of every distinct signature; each suffix is judged once in a range of signatures sorted by their reverse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = Suffixes()
        for batch in batches:
            costs, audits = [], []
            for reverse in batch["reverse"].to_pylist():
                cost, audit = suffixes.node(reverse).edits()
                costs.append(cost)
                audits.append(audit)
            columns = [batch["signature"], pa.array(costs, pa.int64()), pa.array(audits, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["signature", "cost", "audit"])

    rows = signatures.select("signature", F.reverse("signature").alias("reverse"))
    return rows.repartitionByRange("reverse").sortWithinPartitions("reverse").mapInArrow(run, "signature string, cost long, audit string")


def initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def prepared(rows: DataFrame, present: Column) -> DataFrame:
    """Rows with __conv, __turn, __role, __text, __here and __digest (of role and text, by which ties of a turn are ordered)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    own = rows.select(F.col("conv_id").alias("__conv"), F.col("turn").cast("long").alias("__turn"), role.alias("__role"), text.alias("__text"), F.coalesce(present, F.lit(False)).alias("__here"))
    return own.withColumn("__digest", F.unhex(F.md5(F.concat(F.length("__role").cast("string"), F.lit(":"), "__role", "__text").cast("binary"))))


def streamed(rows: DataFrame, first: list[str], kinds: str, run) -> DataFrame:
    """``run`` over rows dealt by conversation and sorted by conversation, ``first``, turn and digest."""
    order = [F.col("__conv").asc_nulls_first(), *map(F.col, first), F.col("__turn").asc_nulls_first(), F.col("__digest").asc()]
    return rows.repartition("__conv").sortWithinPartitions(*order).mapInArrow(run, kinds)


SIGNED = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]


def signed(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, the three faults, illegal and signature of every conversation, from rows without texts."""
    conv = rows.schema["__conv"].dataType.simpleString()
    again = Window.partitionBy("__conv", "__here", "__digest").orderBy(F.col("__turn").asc_nulls_first())
    blank = ~F.col("__text").rlike(NOT_BLANK)
    cut = ~F.col("__text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    narrow = rows.select("__conv", "__turn", "__here", "__digest", initial(F.col("__role")).alias("__initial"), blank.alias("__blank"), cut.alias("__cut"))
    narrow = narrow.repartition("__conv").withColumn("__again", F.row_number().over(again) > 1)
    fault = F.when(F.col("__blank"), "b").when(F.col("__again"), "d").when(F.col("__cut"), "t").otherwise("")
    narrow = narrow.select("__conv", "__turn", "__here", "__digest", "__initial", fault.alias("__fault"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in SIGNED]
        key, any_ = None, False
        turns, low, high = 0, None, None
        faults, illegal, before, letters = {"b": 0, "d": 0, "t": 0}, 0, "", bytearray()

        def end() -> None:
            gaps = high - low + 1 - turns if low is not None else 0
            for column, value in zip(out, (key, gaps, faults["b"], faults["d"], faults["t"], illegal, letters.decode()), strict=True):
                column.append(value)

        for batch in batches:
            for conv, turn, here, first, fault in zip(*(batch[c].to_pylist() for c in ("__conv", "__turn", "__here", "__initial", "__fault")), strict=True):
                if not any_ or conv != key:
                    if any_:
                        end()
                    key, any_ = conv, True
                    turns, low, high = 0, None, None
                    faults, illegal, before, letters = {"b": 0, "d": 0, "t": 0}, 0, "", bytearray()
                if not here:
                    continue
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
                if before and before + first not in ("su", "ua", "au"):
                    illegal += 1
                before = first
                if fault:
                    faults[fault] += 1
                letters += (GONE if fault in ("b", "d") else first.upper() if fault == "t" else first).encode()
            if len(out[0]) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], SIGNED)
                out = [[] for _ in SIGNED]
        if any_:
            end()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], SIGNED)

    types = [_arrow(rows.schema["__conv"].dataType), *[pa.int64()] * 5, pa.string()]
    kinds = f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
    return streamed(narrow, [], kinds, run)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def repaired_rows(rows: DataFrame, audits: DataFrame, digest: bool) -> DataFrame:
    """Conversations as their edits leave them: a row for each row left or put in (conv_id, position, role, text), or, with ``digest``, a
    row for each conversation: conv_id and repaired_sha256 of its ``role:text`` joined by newlines."""
    conv = rows.schema["__conv"].dataType
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    heads = audits.select(F.col("conv_id").alias("__conv"), F.lit(0).alias("__kind"), none("__turn", "long"), none("__digest", "binary"), F.col("audit").alias("__audit"), none("__role", "string"), none("__text", "string"))
    lines = rows.filter("__here").select("__conv", F.lit(1).alias("__kind"), "__turn", "__digest", none("__audit", "string"), "__role", "__text")
    names = ["conv_id", "repaired_sha256"] if digest else ["conv_id", "position", "role", "text"]
    types = [_arrow(conv), pa.string()] if digest else [_arrow(conv), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        key, audit, at, state, position = None, None, 0, 0, 0
        sha = hashlib.sha256()

        def put(role: str, text: str) -> None:
            nonlocal position
            if digest:
                sha.update((("\n" if position else "") + f"{role}:{text}").encode())
            else:
                for column, value in zip(out, (key, position, role, text), strict=True):
                    column.append(value)
            position += 1

        def insertions() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                at, state = at + 1, PUT[state]
                put(ROLE[state], "")

        def end() -> None:
            insertions()
            if digest:
                out[0].append(key)
                out[1].append(sha.hexdigest())

        for batch in batches:
            # a few rows at a time: texts may be long
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for conv, kind, edits, role, text in zip(*(part[c].to_pylist() for c in ("__conv", "__kind", "__audit", "__role", "__text")), strict=True):
                    if kind == 0:
                        if audit is not None:
                            end()
                        key, audit, at, state, position, sha = conv, edits, 0, 0, 0, hashlib.sha256()
                        continue
                    insertions()
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        state = NEXT[state][role[0]]
                        put(role, text)
                    elif edit == "R":
                        state = PUT[state]
                        put(ROLE[state], text)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                out = [[] for _ in names]
        if audit is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    kinds = ", ".join(f"{n} {t}" for n, t in zip(names, [conv.simpleString(), "string"] if digest else [conv.simpleString(), "long", "string", "string"], strict=True))
    return streamed(heads.unionByName(lines), ["__kind"], kinds, run)


#: Signatures of at most COMMON letters that more than one conversation in COMMON has meet their edits by broadcast, two megabytes at most.
COMMON = 1000


def conversation_edits(rows: DataFrame) -> DataFrame:
    """The columns of ``signed``, cost and audit of every conversation of prepared rows."""
    own = written(signed(rows), "signed")
    sizes = own.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    judged = written(signature_edits(sizes.select("signature")), "edits")
    common = sizes.filter((F.col("n") * COMMON > own.count()) & (F.length("signature") <= COMMON)).select("signature")
    hot = written(judged.join(F.broadcast(common), "signature", "left_semi"), "hot")
    many = own.join(F.broadcast(hot), "signature")
    few = own.join(F.broadcast(hot.select("signature")), "signature", "left_anti").join(judged, "signature")
    return many.unionByName(few)


def repairs(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    A conversation's rows stand in order of turn, nulls first, and of the MD5 of role and text within a turn. ``gaps`` are the turns missing
    between the least and the greatest. Each row's first fault counts: blank, duplicate (role and text stand earlier), truncated (its
    last character that is not blank is none of .!?); ``illegal`` are the neighbours whose initials are not su, ua or au. Edits: see the
    module; ``audit`` has their initials (Keep, Rerole, Delete, Insert), the least of the cheapest. A null role or text is one blank; a null
    conv_id is a conversation of its own; repeated rows are duplicates. Rows for which ``present`` does not hold name their conversation
    and do nothing else; a conversation without rows has zeros, no edits and the digest of nothing. A very long text, or a conversation
    of very many rows, streams through one task. An empty table gives no rows. Other columns are not read.
    """
    own = prepared(rows, F.lit(True) if present is None else present)
    edits = written(conversation_edits(own), "conversations")
    digests = repaired_rows(own, edits.select("conv_id", "audit"), digest=True).withColumnRenamed("conv_id", "__its")
    out = edits.join(digests, F.col("conv_id").eqNullSafe(F.col("__its")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role and text of conversations as the cheapest edits leave them; see ``repairs``."""
    own = prepared(rows, F.lit(True))
    edits = written(conversation_edits(own), "conversations")
    return repaired_rows(own, edits.select("conv_id", "audit"), digest=False)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and present of ``rows`` after the damage that crc32 of ``conv_id:turn`` (a null: one blank) modulo 20 names.

    0: the row is gone (present is false), 1: no text, 2: no ``.!?`` in it, 3: it stands twice, 4: its role is user.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    own = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), h.alias("__h"))
    text = F.when(F.col("__h") == 1, "").when(F.col("__h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__h") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("__h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("__h") != 0).alias("present"), F.explode(times)).drop("col")
