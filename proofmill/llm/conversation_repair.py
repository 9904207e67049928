"""Repair of damaged conversations by a Viterbi search that emits edits as its survivors coalesce.

The rows of a conversation pass a small automaton of what has been written so
far: nothing, a system turn, a user's turn or an assistant's.  A row is kept (free,
if its role fits), gets the fitting role (2) or is deleted (3; a must for blank
rows and duplicates), and a fitting turn without text may be inserted anywhere (2);
a truncated row that stays costs 1.  Of each state the cheapest edits survive, of
equally cheap ones those whose initials (D, I, K, R) are least as a string.

Survivors share a tree of back pointers with counted references.  What all of
them agree on leaves the tree at once, a dead branch goes with its last reference,
and a node with one child takes the child's letters over; so the tree has a
branch or two, whose letters are one byte for each row that isn't settled yet.  A
state that another one undercuts whatever follows is dropped, or the empty
beginning would keep every row open.  Ties compare the whole unsettled suffixes:
they part at the nearest common node, at different letters.  Each survivor has a
running digest of the repaired text, so no row's text waits for a decision.

Conversations are dealt by id, sorted by turn, and streamed: memory in a task is
that of one batch and the tree, however long a conversation is.  The digest of
a whole conversation is one sequence by its definition, so a conversation stays in
one task; it is sorted on disk, not gathered.

Defined results: a null role or text is one space, and so is a null id or turn in
the damage's key.  Null turns come first; rows of equal turns follow by role and
text, a row's copy right after it, repeated rows stay repeated.  A null conv_id is
a conversation like any other.  A conversation of which no row is left has zeros,
an empty audit and the digest of nothing.  Empty tables give no rows.  Further
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from proofmill.llm.textscan import over_batches

SPACE = "\x20\t\n\x0b\x0c\r"
#: What has been written: nothing, a system turn, a user's, an assistant's.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that fits next, and the state it leads to.
NEXT = {BEGIN: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
DONE = (BEGIN, ASSISTANT)
INSERT, REROLE, DELETE, CUT = 2, 2, 3, 1
#: State p is dropped if state q is cheaper by more than this: q can follow p in whatever comes at that price.
#: Of a beginning, a system turn is lost (3); a user's turn needs an answer first (2).
UNDERCUT = {(BEGIN, ASSISTANT): DELETE, (BEGIN, USER): DELETE + INSERT, (BEGIN, SYSTEM): DELETE + DELETE + INSERT + INSERT, (SYSTEM, ASSISTANT): 0, (SYSTEM, USER): INSERT, (USER, ASSISTANT): INSERT, (ASSISTANT, USER): INSERT}
FAULTS = ("blank", "duplicate", "truncated")
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Node:
    """A run of edits; ``uses`` counts its children and the survivor that ends in it."""

    __slots__ = ("depth", "letters", "parent", "uses")

    def __init__(self, parent: Node | None, letters: bytes):
        self.parent, self.letters, self.uses = parent, bytearray(letters), 0
        self.depth = 0 if parent is None else parent.depth + 1
        if parent is not None:
            parent.uses += 1


def parts_at(a: Node, x: bytes, b: Node, y: bytes) -> tuple[bytes, bytes]:
    """The texts of two paths, each with what follows it, from their nearest common node on."""
    left, right = [x], [y]
    while a is not b:
        if a.depth >= b.depth:
            left.append(bytes(a.letters))
            a = a.parent
        else:
            right.append(bytes(b.letters))
            b = b.parent
    return b"".join(reversed(left)), b"".join(reversed(right))


def before(a: Node, x: bytes, b: Node, y: bytes) -> bool:
    """Whether path a with x is before path b with y.

    Children of a node begin with different letters, so long suffixes part at once.
    """
    chain: set[int] = set()
    node: Node | None = a
    while node is not None:
        chain.add(id(node))
        node = node.parent
    up, under_b = b, None
    while id(up) not in chain:
        up, under_b = up.parent, up
    node, under_a = a, None
    while node is not up:
        node, under_a = node.parent, node
    if under_a is not None and under_b is not None:
        return under_a.letters < under_b.letters
    left, right = parts_at(a, x, b, y)
    return left < right


class Survivors:
    """The search over one conversation."""

    def __init__(self) -> None:
        self.root = Node(None, b"")
        self.settled = bytearray()
        self.root.uses = 1
        self.alive: dict[int, tuple[int, Node, hashlib._Hash, bool]] = {BEGIN: (0, self.root, hashlib.sha256(), False)}

    @staticmethod
    def _offer(best: dict[int, tuple], state: int, cost: int, source: int, node: Node, letters: bytes, write: tuple[str, ...]) -> None:
        old = best.get(state)
        if old is None or cost < old[0] or (cost == old[0] and before(node, letters, old[2], old[3])):
            best[state] = (cost, source, node, letters, write)

    def _inserted(self) -> dict[int, tuple]:
        """The cheapest way to each state with insertions before the next row: cost, source, its node, letters, roles inserted."""
        best: dict[int, tuple] = {}
        for state, (cost, node, _, _) in self.alive.items():
            at, letters, write = state, b"", ()
            for _ in range(3):
                self._offer(best, at, cost, state, node, letters, write)
                role, at = NEXT[at]
                cost, letters, write = cost + INSERT, letters + b"I", (*write, role)
        return best

    def row(self, role: str, text: str, must_go: bool, cut: bool) -> None:
        best: dict[int, tuple] = {}
        for state, (cost, source, node, letters, write) in self._inserted().items():
            self._offer(best, state, cost + DELETE, source, node, letters + b"D", write)
            if must_go:
                continue
            kept = STEP.get((state, role[:1]))
            if kept is not None:
                self._offer(best, kept, cost + CUT * cut, source, node, letters + b"K", (*write, role))
            fits, then = NEXT[state]
            self._offer(best, then, cost + REROLE + CUT * cut, source, node, letters + b"R", (*write, fits))
        self._move({s: b for s, b in best.items() if not any(q in best and best[q][0] + more < b[0] for (p, q), more in UNDERCUT.items() if p == s)}, text)

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the best repair."""
        best = self._inserted()
        last: dict[int, tuple] = {}
        for state in DONE:
            if state in best:
                cost, source, node, letters, write = best[state]
                self._offer(last, 0, cost, source, node, letters, write)
        self._move(last, None)
        cost, _, digest, _ = self.alive[0]
        return cost, self.settled.decode(), digest.hexdigest()

    def _move(self, best: dict[int, tuple], text: str | None) -> None:
        """Extend the tree to the new survivors, write their texts, and settle what they agree on."""
        new = {}
        for state, (cost, source, node, letters, write) in best.items():
            leaf = node
            if letters:
                leaf = Node(node, letters)
            leaf.uses += 1
            _, _, digest, any_yet = self.alive[source]
            if write:
                digest = digest.copy()
                # The row's own text goes to the last role written, unless the row is deleted: then all are insertions.
                own = letters[-1:] in (b"K", b"R")
                for i, role in enumerate(write):
                    said = text if own and i == len(write) - 1 else ""
                    digest.update(("\n" * any_yet + role + ":" + said).encode())
                    any_yet = True
            new[state] = (cost, leaf, digest, any_yet)
        olds = [v[1] for v in self.alive.values()]
        self.alive = new
        for node in olds:
            self._release(node)
        self._tidy()

    def _release(self, node: Node) -> None:
        node.uses -= 1
        while not node.uses and node.parent is not None:
            node = node.parent
            node.uses -= 1

    def _tidy(self) -> None:
        """Merge nodes with one child into it, and emit the root's letters."""
        for state, (cost, leaf, digest, any_yet) in self.alive.items():
            node = leaf
            while node.parent is not None:
                up = node.parent
                if up.uses == 1:  # this child alone: no survivor ends there
                    up.letters += node.letters
                    node.letters = up.letters
                    node.parent = up.parent
                    if up is self.root:
                        self.root = node
                else:
                    node = up
            self.alive[state] = (cost, leaf, digest, any_yet)
        for _, leaf, _, _ in self.alive.values():
            self._number(leaf)
        self.settled += self.root.letters
        self.root.letters = bytearray()

    def _number(self, node: Node) -> int:
        node.depth = 0 if node.parent is None else self._number(node.parent) + 1
        return node.depth


def damaged(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows that a fixed damage leaves: conv_id, turn, role, text, copy (1 for a repeated row), and whether a row is ``lost``; lost rows have no text."""
    t = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    spell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = t.withColumn("damage", F.crc32(F.concat(spell("conv_id"), F.lit(":"), spell("turn")).cast("binary")) % 20)
    d = F.col("damage")
    t = t.withColumn("text", F.when(d <= 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))).withColumn("role", F.when(d == 4, "user").otherwise(F.col("role")))
    return t.select("conv_id", "turn", "role", "text", (d == 0).alias("lost"), F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, lost, copy) with ``fault``: their first one, or null.

    Rows are dealt by conversation here, once for this and for the search.
    """
    dealt = rows.repartition("conv_id").withColumn("said", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    same = W.partitionBy("conv_id", "lost", "role", "said").orderBy(F.col("turn").asc_nulls_first(), "copy")
    rest = _stripped(F.col("text"))
    fault = F.when(rest == "", "blank").when(F.row_number().over(same) > 1, "duplicate").when(~F.right(rest, F.lit(1)).isin(".", "!", "?"), "truncated")
    return dealt.withColumn("fault", F.when(~F.col("lost"), fault)).drop("said")


class Tally:
    """What is counted of one conversation while its rows pass."""

    def __init__(self, conv_id):
        self.conv_id, self.search = conv_id, Survivors()
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal, self.first, self.last, self.distinct, self.role = 0, None, None, 0, None

    def row(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1
        if self.role is not None:
            self.illegal += self.role[:1] + role[:1] not in ("su", "ua", "au")
        self.role = role
        if fault:
            self.faults[fault] += 1
        self.search.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, *self.search.end())


def repair(rows: DataFrame) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, turn, role, text, lost, copy): its faults, and the cost, initials and digest of its cheapest repair."""
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(RESULT).fields])
    sorted_rows = faults(rows).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy").select("conv_id", "turn", "role", "text", "lost", "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Tally | None = None
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(schema.names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

        kinds = None
        for b in batches:
            kinds = [b.column(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for conv, turn, role, text, lost, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        out.append(now.result())
                    now = Tally(conv)
                if not lost:
                    now.row(turn, role, text, fault)
            if len(out) >= 1000:
                yield batch()
        if now is not None:
            out.append(now.result())
            yield batch()

    return over_batches(sorted_rows, run, schema)


def apply(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, role, text) of every turn that stays or is inserted.

    ``repaired`` has conv_id and audit.  The role of a place follows from the places
    before it, as user and assistant alternate after a system turn.
    """
    kept = rows.filter(~F.col("lost"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    source = kept.withColumn("row", F.row_number().over(order)).select(F.col("conv_id").alias("c"), F.col("row").alias("r"), F.col("role").alias("old"), "text")
    edits = repaired.select("conv_id", F.posexplode(F.split("audit", "")).alias("step", "edit")).filter("edit <> ''")
    upto = W.partitionBy("conv_id").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    edits = edits.withColumn("row", F.when(F.col("edit") != "I", F.sum(F.when(F.col("edit") != "I", 1).otherwise(0)).over(upto)))
    both = edits.join(source, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("row") == F.col("r")), "left").filter("edit <> 'D'")
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("step"))
    first = F.first("lead").over(W.partitionBy("conv_id").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow))
    both = both.withColumn("place", place).withColumn("lead", F.coalesce(F.col("old").startswith("s") & (F.col("edit") == "K"), F.lit(False)).cast("int")).withColumn("lead", first)
    fits = F.when((F.col("place") - F.col("lead")) % 2 == 1, "user").otherwise("assistant")
    return both.select("conv_id", "place", "edit", F.when(F.col("edit") == "K", F.col("old")).otherwise(fits).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))
