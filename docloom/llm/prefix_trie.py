"""A trie of conversations: chained prefix digests, grouped into nodes, with sums over subtrees.

Turns become digests first, so that no text is shuffled. They are numbered by a sort over ranges of (conversation, turn),
whose partitions know how many turns of their first conversation lie before them: a conversation may span all of them.
Digests are chained within segments of ``SEGMENT`` turns, and segments' last digests are chained in turn; equal digests at
equal depth are equal prefixes. Every prefix is a row, and rows grouped by (depth, digest) are nodes.

For sums over subtrees each node is exploded to its ancestors. Nodes in line with the same members are one run, which is
exploded as a whole, and what runs of one member add is counted at the run above them before: a conversation's own tail
costs one row, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.once import written
from docloom.session import shuffle_partitions

SHARED_OF, FAMILY = 9, 5
SEGMENT = 512
CHUNK = 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()


def _marked(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, bytes): a digest in place of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), mark.alias("mark"), F.octet_length(text).cast("long").alias("bytes"))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, at, mark, bytes) with each conversation's turns numbered from 1."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "mark"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for conv in batch.column(0).to_pylist():
                at = at + 1 if conv == last else 1
                last = conv
                places.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()), *batch.columns[2:]], ["conv_id", "part", "at", "mark", "bytes"])

    ranged = _marked(turns).repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    local = written(ranged.mapInArrow(number, "conv_id long, part int, at long, mark binary, bytes long"))
    # a border between partitions is crossed by one conversation at most, so this table has two rows a partition at most
    spans = local.groupBy("conv_id", "part").agg(F.max("at").alias("n"))
    crossing = spans.join(spans.groupBy("conv_id").count().where("count > 1").select("conv_id"), "conv_id")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = crossing.select("conv_id", "part", before.alias("before"))
    return local.join(F.broadcast(offsets), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "mark", "bytes")


def rebuilt(places: DataFrame, shared_of: int = SHARED_OF, family: int = FAMILY) -> DataFrame:
    """Conversations that begin with the first h turns of their family's first one: (conv_id, at, mark, bytes)."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared_of))
    base = F.col("conv_id") - F.col("conv_id") % family
    first_of = places.where(base == F.col("conv_id"))
    firsts = first_of.where(F.col("at") < shared_of).select(F.col("conv_id").alias("base"), "at", "mark", "bytes")
    others = places.where(base != F.col("conv_id"))
    heads = others.select("conv_id", base.alias("base"), h.alias("h")).distinct()
    taken = heads.join(firsts, "base").where(F.col("at") <= F.col("h")).select("conv_id", "at", "mark", "bytes")
    lengths = firsts.groupBy("base").agg(F.max("at").alias("length"))
    own = others.where(F.col("at") > h).withColumns({"base": base, "h": h}).join(lengths, "base", "left")
    moved = own.select("conv_id", (F.col("at") - F.col("h") + F.least("h", F.coalesce("length", F.lit(0)))).alias("at"), "mark", "bytes")
    return first_of.unionByName(taken).unionByName(moved)


def _chain(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """The last column chained along rows of equal first ``key`` columns; rows come sorted."""
    last, digest = None, b""
    for batch in batches:
        out = []
        for *at, mark in zip(*(c.to_pylist() for c in [*batch.columns[:key], batch.column(batch.num_columns - 1)])):
            if at != last:
                last, digest = at, b""
            digest = hashlib.blake2b(digest + mark, digest_size=16).digest()
            out.append(digest)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "digest"])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, bytes) of every prefix of one turn or more; ``turns``: conv_id, at, mark, bytes."""
    tasks = shuffle_partitions(turns.sparkSession)
    rows = turns.select("conv_id", F.floor((F.col("at") - 1) / SEGMENT).cast("long").alias("segment"), F.col("at").alias("depth"), "bytes", "mark")
    dealt = rows.repartition(tasks, "conv_id", "segment").sortWithinPartitions("conv_id", "segment", "depth")
    within = written(dealt.mapInArrow(lambda b: _chain(b, 2), "conv_id long, segment long, depth long, bytes long, digest binary"))
    ends = within.where(F.col("depth") % SEGMENT == 0).select("conv_id", (F.col("segment") + 1).alias("segment"), F.col("digest").alias("mark"))
    chained = ends.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(lambda b: _chain(b, 1), "conv_id long, segment long, digest binary")
    later = within.where("segment > 0").join(chained.withColumnRenamed("digest", "start"), ["conv_id", "segment"])
    later = later.withColumn("digest", F.substring(F.unhex(F.sha2(F.concat("start", "digest"), 256)), 1, 16))
    return within.where("segment = 0").select("conv_id", "depth", "digest", "bytes").unionByName(later.select("conv_id", "depth", "digest", "bytes"))


def member_hashes(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256): SHA-256 of the decimal ids of each node's own conversations, ascending, comma-joined.

    ``ends``: node, depth, conv_id. Ids are sorted over ranges and joined to strings of up to a megabyte where they lie;
    a node's strings then run through one hash, so the ids of a node never are in memory at once.
    """
    tasks = shuffle_partitions(ends.sparkSession)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, None, [], 0

        def chunk():
            return pa.RecordBatch.from_pydict({"node": [key[0]], "depth": [key[1]], "first": [first], "ids": [",".join(ids).encode()]}, schema=pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())]))

        for batch in batches:
            for *at, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (at != key or size > CHUNK):
                    yield chunk()
                    ids, size = [], 0
                if not ids:
                    key, first = at, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield chunk()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def told(done):
            return pa.RecordBatch.from_pydict({"node": [k[0] for k, _ in done], "depth": [k[1] for k, _ in done], "ends_sha256": [x for _, x in done]}, schema=pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]))

        for batch in batches:
            done = []
            for *at, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if at != key:
                    if key is not None:
                        done.append((key, held.hexdigest()))
                    key, held = at, hashlib.sha256(ids)
                else:
                    held.update(b"," + ids)
            yield told(done)
        if key is not None:
            yield told([(key, held.hexdigest())])

    order = ["node", "depth", "conv_id"]
    chunks = ends.select(*order).repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(join, "node long, depth long, first long, ids binary")
    return chunks.repartition(tasks, "node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(digest, "node long, depth long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of ``turns`` (conv_id, at, mark, bytes); ``convs`` names all conversations, turnless ones too. Columns as ``conversation_trie`` has them."""
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    rows = written(prefixes(turns).unionByName(root))
    grouped = rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    nodes = written(grouped)
    # of nodes with one member that member is the name; the others are looked up
    shared = nodes.where("n > 1").select("depth", "digest", "node", "n")
    named = written(rows.select("conv_id", "depth", "digest").join(shared, ["depth", "digest"], "left").select("conv_id", "depth", F.coalesce("node", "conv_id").alias("node"), F.coalesce("n", F.lit(1)).alias("n")))
    above = named.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("n").alias("parent_n"))
    placed = written(nodes.drop("digest").join(above, ["node", "depth"], "left"))
    children = placed.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    counted = written(placed.join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # runs of several members: nodes in line with the same ones
    several = counted.where("n > 1").withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("bytes")})
    down = Window.partitionBy("node", "n").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    suffix = several.withColumns({"leaves": F.sum("leaf").over(down), "saves": F.sum("saved").over(down)})
    tails = counted.where("n = 1 AND parent_n > 1").groupBy(F.col("parent").alias("node"), F.col("parent_n").alias("n")).agg(F.count("*").alias("tails"))
    runs = several.groupBy("node", "n").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).join(tails, ["node", "n"], "left")
    runs = written(runs.select("node", "n", F.coalesce("tails", F.lit(0)).alias("tails"), (F.col("leaf") + F.coalesce("tails", F.lit(0))).alias("leaf"), "saved"))
    members = runs.select(F.col("node").alias("conv_id")).distinct()
    path = named.where("n > 1").join(members, "conv_id", "left_semi").groupBy("conv_id", "node", "n").agg(F.lit(1)).select("conv_id", F.col("node").alias("up"), F.col("n").alias("up_n"))
    exploded = runs.withColumnRenamed("node", "conv_id").join(path, "conv_id").where("up_n > n")
    below = exploded.groupBy(F.col("up").alias("node"), F.col("up_n").alias("n")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    under = runs.select("node", "n", "tails").join(below, ["node", "n"], "left").select("node", "n", (F.col("tails") + F.coalesce("leaf", F.lit(0))).alias("more"), F.coalesce("saved", F.lit(0)).alias("more_saved"))
    one = counted.where("n = 1").select("node", "depth", "parent", "n", "n_children", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    many = suffix.join(under, ["node", "n"]).select("node", "depth", "parent", "n", "n_children", (F.col("leaves") + F.col("more")).alias("n_leaves"), (F.col("saves") + F.col("more_saved")).alias("saved_tokens"))
    last = named.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("x")).select("conv_id", "x.depth", "x.node")
    told = one.unionByName(many).join(member_hashes(last), ["node", "depth"], "left")
    return told.select(
        F.col("node").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    ``conversations``: conv_id, turn, role, text; other columns are ignored. Turns are ordered by number, nulls first, and
    ties by the digest of role and text; repeated rows are a turn each. Null roles and texts are empty. Rows without a
    conv_id belong to no conversation and are left out. Conversations are rebuilt as ``rebuilt`` says; one that is left
    without turns is a member of the root alone. A node is named by its smallest member and its depth. ``n_convs`` counts
    members, ``n_leaves`` childless nodes of the subtree, ``saved_tokens`` what sharing saves there in bytes of text. An
    empty table has no nodes.
    """
    places = written(numbered(conversations))
    return trie(rebuilt(places), places.select("conv_id").distinct())


SQL = f"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
), placed AS (
  SELECT conv_id, sha256(mark) AS mark, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(mark)) AS at
  FROM (SELECT conv_id, turn, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS mark, octet_length(encode(coalesce(text, ''))) AS bytes FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {SHARED_OF} AS h
  FROM (SELECT DISTINCT conv_id FROM placed), crc_table
), turns AS (
  SELECT c.conv_id, p.mark, p.bytes, row_number() OVER (PARTITION BY c.conv_id ORDER BY p.conv_id <> c.base, p.at) AS depth
  FROM convs c JOIN placed p ON (p.conv_id = c.base AND p.at <= h) OR (p.conv_id = c.conv_id AND p.at > h)
), prefixes AS (
  SELECT conv_id, depth, sha256(string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key, bytes FROM turns
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM prefixes GROUP BY depth, key
), named AS (
  SELECT p.conv_id AS member, n.conv_id, n.depth, p.depth = max(p.depth) OVER (PARTITION BY p.conv_id) AS is_end FROM prefixes p JOIN nodes n ON n.depth = p.depth AND n.key = p.key
), linked AS (
  SELECT n.*, a.conv_id AS parent_conv_id FROM nodes n LEFT JOIN named a ON a.member = n.conv_id AND a.depth = n.depth - 1
), children AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2
), counted AS (
  SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.conv_id = l.conv_id AND c.depth = l.depth
), sums AS (
  SELECT a.conv_id, a.depth, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.bytes) AS saved_tokens
  FROM counted c JOIN named a ON a.member = c.conv_id AND a.depth <= c.depth GROUP BY 1, 2
), ends AS (
  SELECT conv_id, depth, sha256(string_agg(member::VARCHAR, ',' ORDER BY member)) AS ends_sha256 FROM named WHERE is_end GROUP BY 1, 2
)
SELECT c.conv_id, c.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM counted c JOIN sums s ON s.conv_id = c.conv_id AND s.depth = c.depth LEFT JOIN ends e ON e.conv_id = c.conv_id AND e.depth = c.depth
"""
