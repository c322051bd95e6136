"""Prefix trie of conversations: union-find over sorted-neighbour LCP edges in descending depth.

A conversation is a path of turns, each a 128-bit digest of role and text.  Paths are sorted by ranges over
all tasks; neighbours in that order share the longest prefixes.  Each task takes the edges between neighbours, whose depth is the length
of their common prefix, deepest first, and unites the two components of each: every merge makes a branching node (or joins the one
that has this depth), and the chains from the components' tops up to it are nodes with one child.  Nodes whose
conversations all lie inside a range are complete there.  What is left of a forest is contracted to its two outer paths,
the first and last conversation with what hangs on each of their nodes; contracted paths are merged by the same union-find
across the boundaries, again by ranges while there are more than ``FAN`` of them.  No step holds more than ``BLOCK`` paths at a time,
and no group of equal conversations is one task.

Members that end at a node are listed in blocks while they are sorted; a node's digest reads its blocks in order.

Defined cases: rows without conv_id belong to no conversation and are left out; turns of equal number are ordered by their digests;
an unknown role or text is empty; c%20 keeps the sign of c; a conversation rebuilt without a turn ends at the root; an empty
table gives no rows, not even a root; other columns are ignored.  A conversation's digests (20 bytes a turn, no texts) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import mapped, materialize, table

#: Bytes of a turn's digest; paths (and bytes of them) that are united together; contracted paths that one task merges; ids listed in a block.
TURN, BLOCK, BLOCK_BYTES, FAN, LISTED = 16, 50_000, 1 << 25, 20_000, 4096
_WORD = r"[^\x20\x09-\x0D]+"
_NOTHING = hashlib.sha256(b"").hexdigest()
_HANGING = "array<struct<depth:int,n:long,least:long,children:long,leaves:long,saved:long>>"
_SCHEMA = (
    "kind string, at long, depth int, conv_id long, parent_conv_id long, parent_at long, n_convs long, n_children long, n_leaves long, "
    f"saved_tokens long, ends string, path binary, words array<int>, hanging {_HANGING}"
)
_ARROW = pa.schema([
    ("kind", pa.string()), ("at", pa.int64()), ("depth", pa.int32()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_at", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("path", pa.binary()), ("words", pa.list_(pa.int32())),
    ("hanging", pa.list_(pa.struct([("depth", pa.int32()), *((c, pa.int64()) for c in ("n", "least", "children", "leaves", "saved"))]))),
])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: for each conversation the array of (turn, digest, words), in order."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(known("role")).cast("string"), F.lit(":"), known("role"), known("text")).cast("binary"))
    words = F.regexp_count(known("text"), F.lit(_WORD)).cast("int")
    one = F.struct(F.col("turn"), digest.alias("digest"), words.alias("words"))
    return conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (digests end to end), words: every conversation with the head that it borrows."""
    own = materialize(turns(conversations))
    lent = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("from_id"), F.slice("turns", 1, 3).alias("lent"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    met = own.join(lent, F.col("conv_id") - F.col("conv_id") % 20 == F.col("from_id"), "left")
    rest = F.slice("turns", head + 1, F.greatest(F.size("turns") - head, F.lit(0)))
    whole = F.concat(F.slice(F.coalesce("lent", F.slice("turns", 1, 0)), F.lit(1), head), rest)
    path = F.unhex(F.array_join(F.transform(whole, lambda t: t.digest), ""))
    return met.select("conv_id", path.alias("path"), F.transform(whole, lambda t: t.words).alias("words"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their start."""
    low, high = 0, min(len(a), len(b)) // TURN
    if a[: high * TURN] == b[: high * TURN]:
        return high
    while low + 1 < high:  # low turns agree, high do not
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * TURN] == b[: mid * TURN] else (low, mid)
    return low if high else 0


class Forest:
    """The trie of some sorted paths.  ``hanging``: for each path, depth -> [n, least, children, leaves, saved] of what hangs there.

    ``whole``: no other path exists, so every node is complete.  Otherwise the nodes on the first and last path are open: others
    may share them, and what hangs on them is kept in ``outer`` (one dictionary for the first path, one for the last).
    """

    def __init__(self, paths: list[bytes], words: list[list[int]], hanging: list[dict[int, list]], whole: bool):
        self.paths, self.words, self.pending, self.whole = paths, words, hanging, whole
        n = len(paths)
        self.up = list(range(n))  # components: union-find with the least path as root, and the last path
        self.end = list(range(n))
        self.depth: list[int] = []  # nodes
        self.value: list[list] = []
        self.parent: list[int] = []
        self.side: list[int] = []  # -1: complete; 0, 1: on the first, last path
        self.same: list[int] = []  # nodes that a merge made one
        self.outer: tuple[dict, dict] = {}, {}
        self.tops = [self._node(i, len(p) // TURN) for i, p in enumerate(paths)]
        self.own = list(self.tops)
        edges = [common(a, b) for a, b in zip(paths, paths[1:], strict=False)]
        for i in sorted(range(n - 1), key=edges.__getitem__, reverse=True):
            self._merge(self._root(i), self._root(i + 1), edges[i])
        self._climb(0, -1)

    def _root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def node(self, k: int) -> int:
        while self.same[k] != k:
            self.same[k] = self.same[self.same[k]]
            k = self.same[k]
        return k

    def _node(self, c: int, depth: int) -> int:
        k = len(self.depth)
        self.depth.append(depth)
        self.value.append(self.pending[c].pop(depth, None) or [0, None, 0, 0, 0])
        self.parent.append(-1)
        self.side.append(-1)
        self.same.append(k)
        return k

    def _climb(self, c: int, to: int) -> None:
        """Finish the nodes of a component from its top to below depth ``to``."""
        k = self.tops[c]
        first, last = c == 0, self.end[c] == len(self.paths) - 1
        while self.depth[k] > to:
            d, value = self.depth[k], self.value[k]
            is_open = not self.whole and (first or last)
            if is_open:
                self.side[k] = 0 if first else 1
                self.outer[self.side[k]][d] = value
            else:
                n, least, children, leaves, saved = value
                value[3] = leaves if children else 1
                if d:
                    value[4] = saved + (n - 1) * self.words[c][d - 1]
            if d == 0:
                break
            above = self._node(c, d - 1)
            self.parent[k] = above
            if not is_open:
                _add(self.value[above], [value[0], value[1], 1, value[3], value[4]])
            k = above
        self.tops[c] = k

    def _merge(self, a: int, b: int, depth: int) -> None:
        """Unite two neighbouring components at the node of this depth."""
        self._climb(a, depth)
        self._climb(b, depth)
        x, y = self.tops[a], self.tops[b]
        self.same[y] = x
        _add(self.value[x], self.value[y])
        for d, value in self.pending[b].items():
            mine = self.pending[a].setdefault(d, [0, None, 0, 0, 0])
            _add(mine, value)
        self.pending[b] = {}
        self.up[b], self.end[a] = a, self.end[b]


def _add(to: list, value: list) -> None:
    to[0] += value[0]
    if value[1] is not None and (to[1] is None or value[1] < to[1]):
        to[1] = value[1]
    for k in (2, 3, 4):
        to[k] += value[k]


class _Rows:
    """Output rows, handed on a few thousand at a time."""

    def __init__(self):
        self.rows: list[dict] = []

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_pylist(self.rows, schema=_ARROW)
            self.rows = []


def _emit(rows: _Rows, forest: Forest, ats: tuple[int, int], names: list[int] | None, ends: list[int] | None) -> Iterator[pa.RecordBatch]:
    """Complete nodes; names of the paths' nodes (levels above the first) or lists of the conversations that end; the contracted paths."""
    digests: dict[int, str] = {}
    if ends is not None:  # the first level: paths are single conversations, equal ones side by side
        i, n = 0, len(ends)
        while i < n:
            j = i + 1
            while j < n and forest.paths[j] == forest.paths[i]:
                j += 1
            k = forest.node(forest.own[i])
            sha = hashlib.sha256() if forest.side[k] < 0 else None
            for at in range(i, j, LISTED):
                listed = ",".join(map(str, ends[at : min(at + LISTED, j)]))
                if sha:
                    sha.update(("," * (at > i) + listed).encode())
                else:
                    rows.rows.append({"kind": "end", "at": ats[0] + at, "parent_at": ats[forest.side[k]], "depth": forest.depth[k], "ends": listed})
            if sha:
                digests[k] = sha.hexdigest()
            i = j
    for k, depth in enumerate(forest.depth):
        if forest.same[k] != k or forest.side[k] >= 0:
            continue
        n, least, children, leaves, saved = forest.value[k]
        above = forest.node(forest.parent[k]) if depth else -1
        outside = depth and forest.side[above] >= 0
        rows.rows.append({
            "kind": "node", "depth": depth, "conv_id": least, "parent_conv_id": None if outside or not depth else forest.value[above][1], "parent_at": ats[forest.side[above]] if outside else None,
            "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends": digests.get(k),
        })
        yield from rows.batches(5000)
    for i, at in enumerate(names or ()):
        k = forest.node(forest.own[i])
        while k >= 0:
            out = forest.side[k] >= 0
            rows.rows.append({"kind": "name", "at": at, "depth": forest.depth[k], "conv_id": None if out else forest.value[k][1], "parent_at": ats[forest.side[k]] if out else None})
            k = forest.node(forest.parent[k]) if forest.parent[k] >= 0 else -1
        yield from rows.batches(5000)
    if not forest.whole:
        for side, i in enumerate({0: 0, len(forest.paths) - 1: 0}):
            hanging = [dict(zip(("depth", "n", "least", "children", "leaves", "saved"), (d, *v), strict=True)) for d, v in sorted(forest.outer[side].items())]
            rows.rows.append({"kind": "path", "at": ats[side], "path": forest.paths[i], "words": forest.words[i], "hanging": hanging})


def united(sorted_paths: DataFrame, first_level: bool, whole: bool) -> DataFrame:
    """The forests of sorted paths, one for every block of each partition (see ``_SCHEMA``)."""

    def run(batches):
        from pyspark import TaskContext

        task, number, rows = TaskContext.get().partitionId(), 0, _Rows()
        held: dict[str, list] = {"paths": [], "words": [], "hanging": [], "keys": []}
        size = 0

        def block():
            nonlocal number, size
            at = ((task << 20) + number) << 24  # orders blocks; below it, lists of ends and the two outer paths
            number += 1
            forest = Forest(held["paths"], held["words"], held["hanging"], whole)
            ats = at, at + (1 << 24) - 1
            yield from _emit(rows, forest, ats, None if first_level else held["keys"], held["keys"] if first_level else None)
            for x in held.values():
                x.clear()
            size = 0

        for batch in batches:
            keys, paths, words = (batch.column(k).to_pylist() for k in ("key", "path", "words"))
            hangs = [None] * len(keys) if first_level else batch.column("hanging").to_pylist()
            for key, path, own, hang in zip(keys, paths, words, hangs, strict=True):
                if not whole and held["paths"] and (len(held["paths"]) >= BLOCK or size > BLOCK_BYTES):
                    yield from block()
                held["paths"].append(path)
                held["words"].append(own)
                held["hanging"].append({len(path) // TURN: [1, key, 0, 0, 0]} if hang is None else {h["depth"]: [h["n"], h["least"], h["children"], h["leaves"], h["saved"]] for h in hang})
                held["keys"].append(key)
                size += 2 * len(path)
        if held["paths"]:
            yield from block()
        yield from rows.batches()

    return mapped(sorted_paths, run, _SCHEMA)


def listed(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends: digests of the lists of (conv_id, depth, at, ends), read in order of ``at``."""

    def run(batches):
        now, sha = None, None
        for batch in batches:
            done = []
            for conv, depth, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "depth", "ends")), strict=True):
                if (conv, depth) != now:
                    if sha:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (conv, depth), hashlib.sha256(text.encode())
                else:
                    sha.update(("," + text).encode())
            yield _digests(done)
        if sha:
            yield _digests([(*now, sha.hexdigest())])

    return mapped(ends.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "at"), run, "conv_id long, depth int, ends string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["conv_id", "depth", "ends"])


def trie(paths: DataFrame, fan: int | None = None) -> DataFrame:
    """The nodes of the trie of (conv_id, path, words); conv_id tells the paths apart."""
    fan = fan or FAN
    spark = paths.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = paths.select(F.col("conv_id").alias("key"), "path", "words").repartitionByRange(ranges, "path", "key").sortWithinPartitions("path", "key")
    levels = [materialize(united(first, True, False))]
    while True:
        outer = levels[-1].where("kind = 'path'").select(F.col("at").alias("key"), "path", "words", "hanging")
        n = outer.count()
        if not n:
            break
        last = n <= fan
        dealt = outer.repartitionByRange(1 if last else -(-n // fan), "key").sortWithinPartitions("key")
        levels.append(materialize(united(dealt, False, last)))
        if last:
            break
    # names of the outer paths' nodes, from the last level down
    name = lambda df: df.where("kind = 'name'").select("at", "depth", "conv_id", "parent_at")
    names = name(levels[-1]).select("at", "depth", "conv_id")
    known = {len(levels) - 1: names}
    for k in range(len(levels) - 2, 0, -1):
        above = names.select(F.col("at").alias("parent_at"), "depth", F.col("conv_id").alias("above"))
        names = materialize(name(levels[k]).join(above, ["parent_at", "depth"], "left").select("at", "depth", F.coalesce("conv_id", "above").alias("conv_id")))
        known[k] = names
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    made = None
    for k, level in enumerate(levels):
        nodes = level.where("kind = 'node'")
        if k + 1 in known:
            above = known[k + 1].select(F.col("at").alias("parent_at"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
            nodes = nodes.join(above, ["parent_at", "depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
        if k and 1 in known:
            ends = levels[0].where("kind = 'end'").select(F.col("at").alias("place"), F.col("parent_at").alias("at"), "depth", "ends").join(known[1], ["at", "depth"])
            digests = listed(ends.select("conv_id", "depth", F.col("place").alias("at"), "ends")).withColumnRenamed("ends", "digest")
            nodes = nodes.join(digests, ["conv_id", "depth"], "left").withColumn("ends", F.col("digest"))
        nodes = nodes.select(*columns)
        made = nodes if made is None else made.unionByName(nodes)
    return made.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations")))


#: The same by listing every prefix of every path.
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) % 4 AS h FROM t
), paths AS (
  SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS path FROM heads c LEFT JOIN heads b ON b.conv_id = c.conv_id - c.conv_id % 20
), hashed AS (
  SELECT conv_id, len(path) AS n, list_transform(path, lambda x: md5(length(x.role) || ':' || x.role || x.text)) AS path, list_transform(path, lambda x: len(regexp_extract_all(x.text, '[^\x20\x09-\x0D]+'))) AS words FROM paths
), cut AS (
  SELECT conv_id, n, d, path[1:d] AS node, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words FROM hashed, unnest(range(0, n + 1)) AS u(d)
), nodes AS (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM cut GROUP BY node, d
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth = p.depth + 1 AND n.node[1:n.depth - 1] = p.node
  LEFT JOIN (SELECT node[1:depth - 1] AS above, depth - 1 AS d, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2) k ON k.above = n.node AND k.d = n.depth
), sums AS (
  SELECT node[1:u.d] AS node, u.d, sum((n_convs - 1) * words) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
  FROM linked, unnest(range(0, depth + 1)) AS u(d) GROUP BY 1, 2
)
SELECT l.conv_id::BIGINT AS conv_id, l.depth::BIGINT AS depth, l.parent_conv_id::BIGINT AS parent_conv_id, l.n_convs::BIGINT AS n_convs, l.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(l.ends) AS ends_sha256
FROM linked l JOIN sums s ON s.node = l.node AND s.d = l.depth
"""
