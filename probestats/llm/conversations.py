"""Repair of the order of roles in conversations by the cheapest edits: Viterbi with coalescing survivors.

A repaired conversation has the role initials ``(s?(ua)+)?``. States are the last initial (or none). Of the edit scripts that
lead to a state only the cheapest, of these the first in ASCII order, survives; survivors are leaves of a tree of
backpointers. A node that nothing refers to is freed, and as soon as all survivors descend from one child of the root,
the root's edits are final: they are emitted and the child becomes the root. So memory holds what is still open, and
survivors that cannot win any more, whatever follows, are cut so that it does not stay open for long.

Two scripts of equal cost are compared over their complete open parts. No script of a number of rows is the beginning of
another one, so the first difference decides, and the order of the survivors' scripts, carried on from row to row, tells it.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from probestats.llm.shared import small
from probestats.operators.ordered import null_safe_join
from probestats.operators.stage import stage

# states: nothing yet, or the last role's initial
STATES = ("", "s", "u", "a")
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
#: What an empty-text message of the missing role in front of a row leads to.
INSERTS = {"": {"": "", "I": "u", "II": "a"}, "s": {"": "s", "I": "u", "II": "a"}, "u": {"": "u", "I": "a"}, "a": {"": "a", "I": "u"}}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
CLOSING = {"": (0, ""), "a": (0, ""), "u": (INSERT, "I"), "s": (2 * INSERT, "II")}
#: BRIDGE[y][x]: the rest costs from y at most this more than from x. From "a" an "s" that is kept from "" is deleted instead.
BRIDGE = {
    "": {"s": 0, "u": INSERT, "a": 2 * INSERT},
    "s": {"": 2 * INSERT, "u": INSERT, "a": 2 * INSERT},
    "u": {"": INSERT + DELETE, "s": INSERT, "a": INSERT},
    "a": {"": DELETE, "s": 0, "u": INSERT},
}
_SPACE = " \t\n\v\f\r"
#: Turns of one conversation that one task takes; longer ones are cut, and their parts looked at by themselves.
PART_ROWS = 100_000

#: cost, place among the survivors' scripts in ASCII order, and the node, by state
Survivors = dict[str, tuple[int, int, "Node | None"]]


@cache
def moves(initial: str, truncated: bool) -> list[tuple[str, str, int, str]]:
    """(from, to, cost, edits) of one row that may stay. Of several ways between two states the cheapest, then first one.

    Nothing is inserted before a row that is deleted: behind it costs the same and comes first.
    """
    kept = TRUNCATED if truncated else 0
    best: dict[tuple[str, str], tuple[int, str]] = {(x, x): (DELETE, "D") for x in STATES}
    for x in STATES:
        for inserted, y in INSERTS[x].items():
            for to in NEXT[y]:
                ways = [(0, "K")] if to == initial else []
                ways += [(REROLE, "R")] if to in ROLES else []
                for cost, edit in ways:
                    way = (cost + kept + INSERT * len(inserted), inserted + edit)
                    best[x, to] = min(best.get((x, to), way), way)
    return [(x, to, *way) for (x, to), way in best.items()]


class Node:
    """A survivor's last row: its edits, deletions of rows that must go behind it, and where it comes from."""

    __slots__ = ("parent", "edits", "after", "children")

    def __init__(self, parent: Node | None, edits: str):
        self.parent, self.edits, self.after, self.children = parent, edits, 0, []


def step(now: Survivors, initial: str, truncated: bool) -> dict[str, tuple[int, int, str, str]]:
    """For each state after a row: cost, place among the scripts, the state before, and the row's edits."""
    best: dict[str, tuple[int, int, str, str]] = {}
    for x, to, cost, edits in moves(initial, truncated):
        if x in now:
            way = (now[x][0] + cost, now[x][1], edits, x)
            if to not in best or way < best[to]:
                best[to] = way
    order = sorted(best, key=lambda t: best[t][1:3])
    return {t: (best[t][0], place, best[t][3], best[t][2]) for place, t in enumerate(order)}


class Decoder:
    """Takes a conversation's rows one by one and hands (edits, row) to ``emit`` as soon as they are final."""

    def __init__(self, emit: Callable[[str, tuple | None], None], entry: str = ""):
        self.emit, self.root = emit, Node(None, "")
        self.now: Survivors = {entry: (0, 0, self.root)}
        self.rows: deque = deque()  # one for each generation of nodes below the root
        self.cost = 0
        self.first = True

    def must_go(self) -> None:
        for x, (cost, place, node) in self.now.items():
            node.after += 1
            self.now[x] = (cost + DELETE, place, node)

    def take(self, initial: str, truncated: bool, row: tuple) -> None:
        found = step(self.now, initial, truncated)
        for x in list(found):  # strictly worse than another one, whatever follows
            if any(found[y][0] + BRIDGE[y][x] < found[x][0] for y in found if y != x):
                del found[x]
        before, self.now = self.now, {}
        for t, (cost, place, x, edits) in found.items():
            node = Node(before[x][2], edits)
            before[x][2].children.append(node)
            self.now[t] = (cost, place, node)
        self.rows.append(row)
        for _, _, node in before.values():
            while not node.children and node is not self.root:
                node.parent.children.remove(node)
                node = node.parent
        while len(self.root.children) == 1:
            self._advance(self.root.children[0])

    def _advance(self, child: Node) -> None:
        self._final(self.root)
        self.root, child.parent = child, None

    def _final(self, node: Node) -> None:
        row = None if self.first else self.rows.popleft()
        self.first = False
        if node.edits or node.after:
            self.emit(node.edits, row)
            if node.after:
                self.emit("D" * node.after, None)

    def finish(self, exit_: str | None = None) -> None:
        """Emits the rest; the script ends in ``exit_``, or closes the conversation if None. Its cost is ``cost`` then."""
        if exit_ is None:
            x = min(self.now, key=lambda s: (self.now[s][0] + CLOSING[s][0], self.now[s][1]))
            more, closing = CLOSING[x]
        else:
            x, more, closing = exit_, 0, ""
        self.cost = self.now[x][0] + more
        path, node = [], self.now[x][2]
        while node is not None:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self._final(node)
        if closing:
            self.emit(closing, None)


class Measures:
    """Counts of a conversation's rows, or of a part of them."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_role = self.last_role = self.low = self.high = None

    def fault(self, turn: int | None, role: str, text: str, seen: bool) -> str | None:
        initial = role[:1]
        if self.first_role is None:
            self.first_role = initial
        else:
            self.illegal += self.last_role + initial not in ("su", "ua", "au")
        self.last_role = initial
        if turn is not None and turn != self.high:  # rows come by turn
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        body = text.rstrip(_SPACE)
        if not body:
            self.blank += 1
            return "blank"
        if seen:
            self.duplicate += 1
            return "duplicate"
        if body[-1] not in ".!?":
            self.truncated += 1
            return "truncated"
        return None

    def more(self, blank: int, duplicate: int, truncated: int, illegal: int, turns: int, first_role: str, last_role: str, low: int | None, high: int | None) -> None:
        """Adds the part that follows."""
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += illegal + (self.last_role is not None and self.last_role + first_role not in ("su", "ua", "au"))
        self.turns += turns - (low is not None and low == self.high)
        self.first_role, self.last_role = first_role if self.first_role is None else self.first_role, last_role
        self.low, self.high = low if self.low is None else self.low, self.high if high is None else high

    def all(self) -> tuple:
        return self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.first_role, self.last_role, self.low, self.high

    def counts(self) -> tuple[int, ...]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


class Writer:
    """Puts emitted edits together: the audit, and the messages (role, text) that they leave."""

    def __init__(self, state: str = ""):
        self.state, self.audit, self.messages = state, [], []

    def __call__(self, edits: str, row: tuple | None) -> None:
        self.audit.append(edits)
        for edit in edits:
            if edit != "D":
                role = row[0] if edit == "K" else ROLES[NEXT[self.state][-1]]
                self.messages.append((role, "" if edit == "I" else row[1]))
                self.state = role[:1]

    def take(self) -> tuple[str, list[tuple[str, str]]]:
        out = "".join(self.audit), self.messages
        self.audit, self.messages = [], []
        return out


_ROW = ["conv_id", "part", "turn", "role", "kind", "copies", "text"]


def _stream(found: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in found:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _turns(rows: Iterator[tuple]) -> Iterator[tuple[int | None, str, str, bool]]:
    """(turn, role, text, seen before) of one conversation's sorted rows; a mark precedes what is not seen before."""
    new = False
    for _, _, turn, role, kind, copies, text in rows:
        if kind == _MARK:
            new = True
        elif kind == _TURN:
            for _ in range(copies):
                yield turn, role, text, not new
                new = False


def _decode(rows: Iterator[tuple], decoder: Decoder, measures: Measures, exit_: str | None = None) -> Iterator[None]:
    """Yields after each row, and after the end."""
    for turn, role, text, seen in _turns(rows):
        fault = measures.fault(turn, role, text, seen)
        if fault in ("blank", "duplicate"):
            decoder.must_go()
        else:
            decoder.take(role[:1] if role[:1] in STATES[1:] else "-", fault == "truncated", (role, text))
        yield
    decoder.finish(exit_)
    yield


def _whole(found: Iterator[pa.RecordBatch], messages: bool) -> Iterator[pa.RecordBatch]:
    """Conversations that are whole in their task."""
    out = _Batches(MESSAGES if messages else DIGESTS)
    for conv_id, rows in groupby(_stream(found, _ROW), key=lambda r: r[0]):
        writer, measures, digest, audit, nth = Writer(), Measures(), _Digest(), [], 0
        decoder = Decoder(writer)
        for _ in _decode(rows, decoder, measures):
            edits, left = writer.take()
            audit.append(edits)
            digest.update(left)
            if messages:
                for role, text in left:
                    yield from out.add((conv_id, 0, nth, role, text), len(text))
                    nth += 1
        if not messages:
            yield from out.add((conv_id, *measures.counts(), decoder.cost, "".join(audit), digest.hexdigest()), len(audit))
    yield from out.rest()


class _Digest:
    """SHA-256 of ``role:text``, joined by line ends."""

    def __init__(self):
        self.sha, self.joint = hashlib.sha256(), b""

    def update(self, messages: list[tuple[str, str]]) -> None:
        for role, text in messages:
            self.sha.update(self.joint + f"{role}:{text}".encode())
            self.joint = b"\n"

    def hexdigest(self) -> str:
        return self.sha.hexdigest()


class _Batches:
    """Collects rows into record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= 10_000 or self.size > 4_000_000:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(self.schema, zip(*self.rows, strict=True), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in columns], schema=self.schema)
        self.rows, self.size = [], 0


def _schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema(list(fields.items()))


_LONGS, _TEXT = pa.list_(pa.int64()), pa.string()
DIGESTS = _schema(conv_id=pa.int64(), **dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], pa.int64()), audit=_TEXT, repaired_sha256=_TEXT)
MESSAGES = _schema(conv_id=pa.int64(), part=pa.int64(), nth=pa.int64(), role=_TEXT, text=_TEXT)
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_MEASURES = dict.fromkeys(_COUNTS, pa.int64()) | {"first_role": _TEXT, "last_role": _TEXT, "low": pa.int64(), "high": pa.int64()}
_PARTS = _schema(conv_id=pa.int64(), part=pa.int64(), **_MEASURES, costs=_LONGS, places=_LONGS)
_ENDS = _schema(conv_id=pa.int64(), part=pa.int64(), entry=_TEXT, exit=_TEXT, last=pa.bool_(), **dict.fromkeys(["gaps", *_COUNTS[:4], "cost"], pa.int64()), closing=_TEXT)
_PIECES = _schema(conv_id=pa.int64(), part=pa.int64(), nth=pa.int64(), audit=_TEXT, roles=pa.list_(_TEXT), texts=pa.list_(_TEXT))
_MARK, _TURN = 1, 2


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", _TEXT: "string", pa.bool_(): "boolean", _LONGS: "array<long>", pa.list_(_TEXT): "array<string>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _part_tables(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part: costs of the best scripts between all pairs of states, and their places among those of one entry."""
    out = _Batches(_PARTS)
    for (conv_id, part), rows in groupby(_stream(found, _ROW), key=lambda r: r[:2]):
        measures, tables = Measures(), {e: {e: (0, 0, None)} for e in STATES}
        for turn, role, text, seen in _turns(rows):
            fault = measures.fault(turn, role, text, seen)
            for e, now in tables.items():
                if fault in ("blank", "duplicate"):
                    tables[e] = {x: (cost + DELETE, place, None) for x, (cost, place, _) in now.items()}
                else:
                    initial = role[:1] if role[:1] in STATES[1:] else "-"
                    tables[e] = {t: (cost, place, None) for t, (cost, place, _, _) in step(now, initial, fault == "truncated").items()}
        flat = [tables[e].get(x, (None, None, None)) for e in STATES for x in STATES]
        yield from out.add((conv_id, part, *measures.all(), [c for c, _, _ in flat], [p for _, p, _ in flat]), 300)
    yield from out.rest()


def _part_ends(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states in which the best script enters and leaves each part. One short row a part is held."""
    out = _Batches(_ENDS)
    for conv_id, rows in groupby(_stream(found, _PARTS.names), key=lambda r: r[0]):
        now, backs, parts, measures = {"": (0, 0)}, [], [], Measures()
        for _, part, *counted, costs, places in rows:
            measures.more(*counted)
            best: dict[str, tuple] = {}
            for e, (cost, place) in now.items():
                for x in STATES:
                    at = STATES.index(e) * len(STATES) + STATES.index(x)
                    if costs[at] is not None:
                        way = (cost + costs[at], place, places[at], e)
                        best[x] = min(best.get(x, way), way)
            order = sorted(best, key=lambda x: best[x][1:3])
            now = {x: (best[x][0], i) for i, x in enumerate(order)}
            backs.append({x: way[3] for x, way in best.items()})
            parts.append(part)
        x = min(now, key=lambda s: (now[s][0] + CLOSING[s][0], now[s][1]))
        cost, closing = now[x][0] + CLOSING[x][0], CLOSING[x][1]
        for i in reversed(range(len(parts))):
            e = backs[i][x]
            last = i == len(parts) - 1
            yield from out.add((conv_id, parts[i], e, x, last, *measures.counts(), cost, closing if last else ""), 100)
            x = e
    yield from out.rest()


def _part_pieces(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and messages of each part, in pieces, between the states that are known now."""
    out = _Batches(_PIECES)
    for (conv_id, part, entry, exit_, closing), rows in groupby(_stream(found, ["conv_id", "part", "entry", "exit", "closing", *_ROW[2:]]), key=lambda r: r[:5]):
        writer, nth, size = Writer(entry), 0, 0
        decoder = Decoder(writer, entry)
        turns = ((conv_id, part, *r[5:]) for r in rows)
        for i, _ in enumerate(_decode(turns, decoder, Measures(), exit_)):
            if i % 256 == 255:
                size = sum(len(text) for _, text in writer.messages)
                if size > 1_000_000 or i % 8192 == 8191:
                    audit, left = writer.take()
                    yield from out.add((conv_id, part, nth, audit, [r for r, _ in left], [t for _, t in left]), size)
                    nth += 1
        if closing:
            writer(closing, None)
        audit, left = writer.take()
        yield from out.add((conv_id, part, nth, audit, [r for r, _ in left], [t for _, t in left]), sum(len(t) for _, t in left))
    yield from out.rest()


def _joined(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits and digests over the pieces of a conversation, which come in order and are not held."""
    out = _Batches(_schema(conv_id=pa.int64(), audit=_TEXT, repaired_sha256=_TEXT))
    for conv_id, rows in groupby(_stream(found, _PIECES.names), key=lambda r: r[0]):
        digest, audit = _Digest(), []
        for _, _, _, edits, roles, texts in rows:
            audit.append(edits)
            digest.update(zip(roles, texts, strict=True))
        yield from out.add((conv_id, "".join(audit), digest.hexdigest()), 0)
    yield from out.rest()


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, ``copies``: one row in five damaged, as CRC-32 of ``conv_id:turn`` tells.

    NULL fields count as one space (but a NULL conv_id or turn stays NULL in its column).
    """
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    harm = F.crc32(F.encode(F.concat(spaced[0], F.lit(":"), spaced[1]), "utf-8")) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), spaced[2].alias("role"), spaced[3].alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 3, 2).otherwise(1).cast("long")
    return rows.where(F.col("harm") != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def repair(rows: DataFrame, ids: DataFrame | None = None, messages: bool = False, part_rows: int = PART_ROWS) -> DataFrame:
    """Faults of each conversation and its cheapest repair. Runs jobs.

    ``rows``: conv_id, turn, role, text and, if there, ``copies`` (how many rows one stands for). One row per conversation:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; with ``messages`` instead the
    repaired messages: conv_id, part, nth, role, text, in order of part and nth. Ids in ``ids`` that have no row give an
    empty conversation.

    Rows are taken by turn, NULL first, then role, then the text's SHA-256; equal rows follow each other. NULL roles and
    texts count as one space; a NULL conv_id is one conversation. Other columns are ignored. Empty table: no rows.

    Which rows repeat an earlier one is found by grouping digests, so no task remembers a conversation's texts. Conversations
    of over ``part_rows`` rows are cut by the order of their rows. Parts are looked at apart, for every state they may
    be entered in; a table of fixed size a part tells the states of the best script; then all parts are decoded. Only the
    digest needs a long conversation's pieces one after the other, and holds none of them.
    """
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *spaced, copies.alias("copies"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    key = ["conv_id", "role", "digest"]
    firsts = rows.groupBy(*key).agg(F.min(F.struct("turn"))["turn"].alias("turn"))
    marks = firsts.select("conv_id", "turn", "role", "digest", _kind(_MARK), F.lit(0).cast("long").alias("copies"), F.lit(None).cast("string").alias("text"))
    turns = rows.select("conv_id", "turn", "role", "digest", _kind(_TURN), "copies", "text")
    ids = rows.select("conv_id") if ids is None else ids.select(F.col("conv_id").cast("long"))
    empty = [F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("digest", "string"))]
    names = ids.distinct().select("conv_id", *empty, _kind(0), F.lit(0).cast("long").alias("copies"), F.lit(None).cast("string").alias("text"))

    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"))
    long = stage(sizes.where(F.col("n") > part_rows), "long_conversations")
    n_long = long.agg(F.sum("n")).first()[0] or 0
    order = ["conv_id", "turn", "role", "digest", "kind"]
    every = turns.unionByName(marks)
    schema = MESSAGES if messages else DIGESTS
    short = every.unionByName(names)
    if n_long:
        short = null_safe_join(short, small(long.select("conv_id")), ["conv_id"], "left_anti")
    whole = short.withColumn("part", F.lit(0).cast("long")).repartition("conv_id").sortWithinPartitions(*order)
    out = whole.select(*_ROW).mapInArrow(lambda found: _whole(found, messages), _ddl(schema))
    if not n_long:
        return out

    # equal rows are counted before they are dealt, and a mark goes with its row
    cut = null_safe_join(every, small(long.select("conv_id")), ["conv_id"], "left_semi")
    cut = cut.groupBy(*order, "text").agg(F.sum("copies").alias("copies"))
    n_parts = ceil(n_long / part_rows)
    dealt = cut.repartitionByRange(n_parts, *order[:-1]).withColumn("part", F.spark_partition_id().cast("long"))
    dealt = stage(dealt, "long_parts")

    def by_part(df: DataFrame) -> DataFrame:
        return df.repartitionById(n_parts, F.col("part").cast("int")).sortWithinPartitions("part", *order)

    tables = by_part(dealt).select(*_ROW).mapInArrow(_part_tables, _ddl(_PARTS))
    ends = tables.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_part_ends, _ddl(_ENDS))
    ends = stage(ends, "long_ends")
    known = null_safe_join(dealt, small(ends.select("conv_id", "part", "entry", "exit", "closing")), ["conv_id", "part"])
    pieces = by_part(known).select("conv_id", "part", "entry", "exit", "closing", *_ROW[2:]).mapInArrow(_part_pieces, _ddl(_PIECES))
    if messages:
        each = pieces.select("conv_id", "part", "nth", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "m"))
        found = each.select("conv_id", "part", (F.col("nth") * F.lit(1 << 32) + F.col("i")).alias("nth"), F.col("m.roles").alias("role"), F.col("m.texts").alias("text"))
    else:
        joined = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth").mapInArrow(_joined, "conv_id long, audit string, repaired_sha256 string")
        counts = ends.where("last").select("conv_id", "gaps", *_COUNTS[:4], "cost")
        found = null_safe_join(joined, counts, ["conv_id"]).select(*schema.names)
    return out.unionByName(found)


def _kind(kind: int) -> Column:
    return F.lit(kind).alias("kind")
