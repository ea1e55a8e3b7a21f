"""Prefix trie of conversations: succinct level-order tries of shards of prefixes, heavy upper levels merged separately.

Turns are numbered in a range-sorted table, in which a long conversation may span tasks: each task numbers its part, and what
a part takes over from the part before (at most one row a task) is added afterwards. So is the hash of the turns so far, a
polynomial over two words of each turn's digest modulo 2^61 - 1: such hashes of parts can be put together. A conversation is
rebuilt from its base's first turns and its own later ones, and its prefixes' hashes follow from those of the parts by
arithmetic, without touching turns again. A node of the trie is a depth and a hash of 122 bits (equal hashes are taken for
equal turns). Equal conversations become one, with a count, before their turns are dealt out as rows to the nodes.

Nodes above whose subtree more than SHARD_ROWS turns of different conversations lie are heavy, and so is the root. What lies
below a heavy node's other children is cut into shards by prefix: whole subtrees of a bounded size. Shards are packed into
groups, and numpy builds the LOUDS of each: nodes in level order, a bit vector with each node's degree in unary, arrays of
labels; parents are read from it by rank and select, and passes in reverse level order add children to their parents. Heavy
nodes get the sums of their shards and then sum each other by doubling their jumps to ancestors, in as many rounds as the
depth has bits.

Defined cases: rows with a null id take no part; null roles and texts are empty; turns of a conversation with one number (null:
before all) are ordered by the md5 of role and text; repeated rows are turns of their own; a conversation whose base is absent
or short takes over what is there, if need be nothing, and may have no turn; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

PRIME = (1 << 61) - 1
#: Bases of the two polynomials (fixed values).
BASES = (911_382_323_456_789_013, 1_372_583_924_811_207_391)
#: Base conversations are multiples of it; shared turns are fewer than KINDS.
FAMILY, KINDS = 100, 6
#: Turns below a node from which on it is heavy, and nodes in a group of shards.
SHARD_ROWS, GROUP_NODES = 16_384, 8_192
#: Ids that are joined to one piece of text before they are digested.
PIECE_IDS = 8_192
KEY = ["depth", "k1", "k2"]


def turn_digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def ranked_turns(turns: DataFrame) -> DataFrame:
    """c, i, h1, h2, p1, p2, chars for turns (c, turn, digest, chars): number from 1, hash up to the turn and before it."""
    order = ["c", F.col("turn").asc_nulls_first(), "digest"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "digest", "chars")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, own, i, h1, h2 = TaskContext.get().partitionId(), None, 0, 0, 0
        for pdf in batches:
            rows = []
            for c, digest, chars in zip(pdf["c"].tolist(), pdf["digest"], pdf["chars"].tolist(), strict=True):
                if c != own:
                    own, i, h1, h2 = c, 0, 0, 0
                p1, p2, i = h1, h2, i + 1
                h1, h2 = (h1 * BASES[0] + int(digest[:16], 16)) % PRIME, (h2 * BASES[1] + int(digest[16:], 16)) % PRIME
                rows.append((part, c, i, h1, h2, p1, p2, chars))
            yield pd.DataFrame(rows, columns=["part", "c", "i", "h1", "h2", "p1", "p2", "chars"])

    ranked = checkpointed(dealt.mapInPandas(walk, "part int, c long, i long, h1 long, h2 long, p1 long, p2 long, chars long"))
    # One row for each task: its first conversation, and where its last one stands at its end.
    edges = ranked.groupBy("part").agg(F.min("c").alias("first"), F.max(F.struct("c", "i", "h1", "h2")).alias("end")).orderBy("part").collect()
    carried, state = {}, None
    for e in edges:
        c, i, h1, h2 = e["end"]
        if state and state[0] == e["first"]:
            carried[e["part"]] = state
            if c == state[0]:
                i, h1, h2 = i + state[1], (h1 + state[2] * pow(BASES[0], i, PRIME)) % PRIME, (h2 + state[3] * pow(BASES[1], i, PRIME)) % PRIME
        state = (c, i, h1, h2)
    if not carried:
        return ranked.drop("part")
    shared = turns.sparkSession.sparkContext.broadcast(carried)

    def take_over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in pdf["part"].unique():
                if part not in shared.value:
                    continue
                c, before, *hashes = shared.value[part]
                rows = pdf.index[(pdf["part"] == part) & (pdf["c"] == c)]
                places = pdf.loc[rows, "i"].tolist()
                for base, carry, now, last in zip(BASES, hashes, ("h1", "h2"), ("p1", "p2"), strict=True):
                    pdf.loc[rows, now] = [(h + carry * pow(base, i, PRIME)) % PRIME for h, i in zip(pdf.loc[rows, now].tolist(), places, strict=True)]
                    pdf.loc[rows, last] = [(h + carry * pow(base, i - 1, PRIME)) % PRIME for h, i in zip(pdf.loc[rows, last].tolist(), places, strict=True)]
                pdf.loc[rows, "i"] += before
            yield pdf

    return ranked.mapInPandas(take_over, ranked.schema).drop("part")


def moved(h1: str, h2: str, d1: str, d2: str, turns: Column) -> Column:
    """Struct (k1, k2): hashes to which other first turns, whose hash is larger by d, are given `turns` turns before the end."""

    @F.pandas_udf("k1 long, k2 long")
    def move(h1: pd.Series, h2: pd.Series, d1: pd.Series, d2: pd.Series, turns: pd.Series) -> pd.DataFrame:
        out = []
        for h, d, base in ((h1, d1, BASES[0]), (h2, d2, BASES[1])):
            out.append([(a + x * pow(base, n, PRIME)) % PRIME if x else a for a, x, n in zip(h.tolist(), d.tolist(), turns.tolist(), strict=True)])
        return pd.DataFrame({"k1": out[0], "k2": out[1]}, dtype=np.int64)

    return move(h1, h2, d1, d2, turns)


def rebuilt(ranked: DataFrame) -> DataFrame:
    """A row for each conversation c: h, u (turns taken over), heads of its base, shift of its own hashes, and its end node."""
    at = lambda j: F.max(F.when(F.col("i") == j, F.struct("h1", "h2", "chars"))).alias(f"s{j}")
    heads = [f"s{j}" for j in range(1, KINDS)]
    convs = checkpointed(ranked.groupBy("c").agg(F.max("i").alias("n"), F.max_by(F.struct("h1", "h2"), "i").alias("end"), *[at(j) for j in range(1, KINDS)]))
    bases = convs.select(F.col("c").alias("b"), F.col("n").alias("bn"), F.array(*heads).alias("heads"))
    own = convs.withColumns({"b": F.col("c") - F.col("c") % FAMILY, "h": (F.crc32(F.col("c").cast("string").cast("binary")) % KINDS).cast("long")}).join(bases, "b", "left")
    own = own.withColumn("u", F.least("h", F.coalesce("bn", F.lit(0))))
    hash_at = lambda many, j, k: F.when(j > 0, F.get(many, (j - 1).cast("int"))[f"h{k}"]).otherwise(0).cast("long")
    longer, (base, mine) = F.col("n") > F.col("h"), [(F.col("heads"), F.col("u")), (F.array(*heads), F.col("h"))]
    # Where own turns are left, all of mine's first h are there.
    shift = [F.when(longer, F.pmod(hash_at(*base, k) - hash_at(*mine, k), F.lit(PRIME))).otherwise(0).cast("long").alias(f"d{k}") for k in (1, 2)]
    own = own.select("c", "h", "u", "n", "end", "heads", longer.alias("longer"), *shift, *[hash_at(*base, k).alias(f"b{k}") for k in (1, 2)])
    key = F.when(F.col("longer"), moved("end.h1", "end.h2", "d1", "d2", F.greatest(F.col("n") - F.col("h"), F.lit(0)))).otherwise(F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2")))
    size = F.col("u") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return checkpointed(own.withColumn("key", key).select("c", "h", "u", "heads", "d1", "d2", size.alias("depth"), "key.k1", "key.k2"))


def trie_nodes(ranked: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of different conversations as rows (c and the node), and the nodes below the root with their own figures."""
    reps = convs.where("depth > 0").groupBy(*KEY).agg(F.min("c").alias("c"), F.count("*").alias("copies")).select("c", "copies", F.col("depth").alias("size"))
    reps = checkpointed(reps.join(convs.select("c", "h", "u", "heads", "d1", "d2"), "c"))
    own = ranked.join(reps.drop("heads"), "c").where("i > h")
    own = own.select(
        "c", "copies", "size", (F.col("u") + F.col("i") - F.col("h")).alias("depth"), moved("h1", "h2", "d1", "d2", F.col("i") - F.col("h")).alias("k"),
        moved("p1", "p2", "d1", "d2", F.col("i") - 1 - F.col("h")).alias("q"), "chars",
    ).select("c", "copies", "size", "depth", "k.k1", "k.k2", F.col("q.k1").alias("q1"), F.col("q.k2").alias("q2"), "chars")
    taken = reps.where("u > 0").select("c", "copies", "size", "heads", F.explode(F.sequence(F.lit(1).cast("long"), F.col("u"))).alias("depth"))
    head = lambda back, name: F.get("heads", (F.col("depth") - 1 - back).cast("int"))[name]
    taken = taken.select("c", "copies", "size", "depth", head(0, "h1").alias("k1"), head(0, "h2").alias("k2"), *[F.coalesce(head(1, f"h{k}"), F.lit(0)).cast("long").alias(f"q{k}") for k in (1, 2)], head(0, "chars").alias("chars"))
    rows = checkpointed(own.unionByName(taken))
    nodes = rows.groupBy(*KEY).agg(
        F.min("c").alias("conv"), F.sum("copies").alias("n"), F.sum(F.col("size") - F.col("depth") + 1).alias("below"), F.first("chars").alias("chars"), F.first("q1").alias("q1"), F.first("q2").alias("q2")
    )
    return rows, checkpointed(nodes)


def louds(parent: np.ndarray, level: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level order of a forest, its bit vector and the bounds of its levels.

    parent: row of each node's parent, -1 for the trees' tops, which hang on a node above all of them. Siblings are in order
    of their labels. The bit vector holds a 1 for each child and then a 0, for the node above all and each node in order.
    """
    place, order, bounds = np.zeros(len(parent), dtype=np.int64), [], [0]
    for at in range(int(level.max()) + 1):
        rows = np.flatnonzero(level == at)
        above = np.where(parent[rows] >= 0, place[parent[rows]], 0)
        rows = rows[np.lexsort((label[rows], above))]
        place[rows] = bounds[-1] + np.arange(len(rows))
        order.append(rows)
        bounds.append(bounds[-1] + len(rows))
    order = np.concatenate(order)
    degree = np.bincount(np.where(parent >= 0, place[parent] + 1, 0), minlength=len(parent) + 1)
    bits = np.ones(2 * len(parent) + 1, dtype=bool)
    bits[np.cumsum(degree) + np.arange(len(degree))] = False
    return order, bits, np.array(bounds)


def louds_parents(bits: np.ndarray) -> np.ndarray:
    """The parent of each node in level order: the zeros before its 1, less the one of the node above all; -1 for a top."""
    return np.cumsum(~bits)[np.flatnonzero(bits)] - 1


def louds_degrees(bits: np.ndarray) -> np.ndarray:
    """The children of each node in level order: the ones between two zeros."""
    return np.diff(np.flatnonzero(~bits)) - 1


def roll_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """A group of shards: whole subtrees with their nodes' figures. Adds children, leaves and savings below each node."""
    keys = pd.MultiIndex.from_arrays([pdf["depth"], pdf["k1"], pdf["k2"]])
    above = keys.get_indexer(pd.MultiIndex.from_arrays([pdf["depth"] - 1, pdf["q1"], pdf["q2"]]))
    above = np.where(pdf["depth"].to_numpy() == pdf["top"].to_numpy(), -1, above)
    order, bits, bounds = louds(above, (pdf["depth"] - pdf["top"]).to_numpy(), pdf["k1"].to_numpy())
    pdf = pdf.iloc[order]
    parent, degree = louds_parents(bits), louds_degrees(bits)
    leaves, saved = (degree == 0).astype(np.int64), ((pdf["n"] - 1) * pdf["chars"]).to_numpy().copy()
    for low, high in zip(bounds[-2:0:-1], bounds[:1:-1], strict=True):  # all levels but the top, the deepest first
        np.add.at(leaves, parent[low:high], leaves[low:high])
        np.add.at(saved, parent[low:high], saved[low:high])
    conv = pdf["conv"].to_numpy()
    return pdf[[*KEY, "q1", "q2", "conv", "n"]].assign(top=parent < 0, parent=np.where(parent < 0, 0, conv[parent]), children=degree, leaves=leaves, saved=saved)


def shard_nodes(rows: DataFrame, nodes: DataFrame, heavy: DataFrame, shard_rows: int, group_nodes: int) -> DataFrame:
    """The light nodes with what lies below them; top: whether the parent is heavy."""
    light = nodes.where(F.col("below") <= shard_rows)
    marked = rows.select("c", *KEY).join(heavy.select(*KEY, F.lit(True).alias("heavy")), KEY, "left")
    tops = marked.where("heavy is null").groupBy("c").agg(F.min(F.struct(*KEY)).alias("s")).select(F.col("c").alias("conv"), "s")
    groups = max(1, -(-light.count() // group_nodes))
    dealt = light.join(tops, "conv").select("*", F.col("s.depth").alias("top"), F.pmod(F.xxhash64("s"), F.lit(groups)).alias("group")).drop("s", "below")
    out = "depth long, k1 long, k2 long, q1 long, q2 long, conv long, n long, top boolean, parent long, children long, leaves long, saved long"
    return checkpointed(dealt.groupBy("group").applyInPandas(roll_up, out))


def merge_heavy(heavy: DataFrame, tops: DataFrame) -> DataFrame:
    """Heavy nodes (KEY, q1, q2, conv, n, chars; the root's q is null) with children, leaves and savings of all below them."""
    up = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")]
    ids = checkpointed(heavy.withColumn("id", F.monotonically_increasing_id()))
    below = tops.select(*up, "leaves", "saved").unionByName(ids.where("depth > 0").select(*up, F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")))
    sums = below.groupBy(*KEY).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    own = (F.col("n") - 1) * F.col("chars")
    parents = ids.select(*KEY, F.col("id").alias("up"), F.col("conv").alias("parent"))
    state = ids.join(sums, KEY, "left").select(
        "id", *KEY, "q1", "q2", "conv", "n", F.coalesce("children", F.lit(0)).alias("children"), F.when(F.col("children").isNull(), 1).otherwise(F.col("leaves")).cast("long").alias("leaves"), (own + F.coalesce("saved", F.lit(0))).alias("saved")
    )
    state = checkpointed(joined_parents(state, parents))
    while not state.where("up is not null").isEmpty():
        more = state.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        jump = state.select(F.col("id").alias("up"), F.col("up").alias("_up"))
        state = state.join(more, "id", "left").join(jump, "up", "left").withColumns({"leaves": F.col("leaves") + F.coalesce("_l", F.lit(0)), "saved": F.col("saved") + F.coalesce("_s", F.lit(0)), "up": F.col("_up")})
        state = checkpointed(state.drop("_l", "_s", "_up"))
    return state


def joined_parents(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """nodes with the columns of their parents (KEY and others), null for the root."""
    above = parents.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), *[c for c in parents.columns if c not in KEY])
    return nodes.join(above, ["depth", "q1", "q2"], "left")


def end_digests(convs: DataFrame) -> DataFrame:
    """KEY and sha: the SHA-256 of the ids, in order and joined by commas, of the conversations that end at a node.

    Ids are sorted over all tasks and joined piece by piece where they lie; one task reads a node's pieces in order.
    """
    order = [*KEY, "c"]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            change, at = (pdf[KEY] != pdf[KEY].shift()).any(axis=1).to_numpy(), np.arange(len(pdf))
            since = at - np.maximum.accumulate(np.where(change, at, 0)) if len(pdf) else at
            starts = np.flatnonzero(since % PIECE_IDS == 0)
            ids = pdf["c"].astype(str).to_numpy()
            yield pdf.iloc[starts].assign(piece=[",".join(x).encode() for x in np.split(ids, starts[1:])])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha = None, None
        for pdf in batches:
            done = []
            for *own, piece in pdf[[*KEY, "piece"]].itertuples(index=False, name=None):
                if own == key:
                    sha.update(b"," + piece)
                else:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = own, hashlib.sha256(piece)
            yield pd.DataFrame(done, columns=[*KEY, "sha"])
        if key is not None:
            yield pd.DataFrame([(*key, sha.hexdigest())], columns=[*KEY, "sha"])

    pieces = convs.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(join, "depth long, k1 long, k2 long, c long, piece binary")
    return pieces.repartition(*KEY).sortWithinPartitions(*order).mapInPandas(digest, "depth long, k1 long, k2 long, sha string")


def conversation_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", shard_rows: int = SHARD_ROWS, group_nodes: int = GROUP_NODES) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    bounded_batches(turns.sparkSession)
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), turn_digest(r, t).alias("digest"), F.length(t).cast("long").alias("chars"))
    ranked = ranked_turns(rows)
    convs = rebuilt(ranked)
    rows, nodes = trie_nodes(ranked, convs)
    whole = convs.agg(F.min("c").alias("conv"), F.count("*").alias("n")).where("n > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = whole.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv", "n", zero.alias("chars"), none.alias("q1"), none.alias("q2"))
    heavy = checkpointed(nodes.where(F.col("below") > shard_rows).drop("below").unionByName(root))
    sharded = shard_nodes(rows, nodes, heavy.where("depth > 0"), shard_rows, group_nodes)
    merged = merge_heavy(heavy, sharded.where("top"))
    # The root is the parent of all nodes of depth 1; it needs no join.
    first = whole.select(F.col("conv").alias("_root"))
    upper = joined_parents(sharded.where("top and depth > 1").drop("parent"), heavy.select(*KEY, F.col("conv").alias("parent")))
    level = sharded.where("top and depth = 1").drop("parent").crossJoin(F.broadcast(first)).withColumnRenamed("_root", "parent")  # first: one row
    columns = [*KEY, "conv", "parent", "n", "children", "leaves", "saved"]
    every = sharded.where("not top").select(columns).unionByName(upper.select(columns)).unionByName(level.select(columns)).unionByName(merged.select(columns))
    digests = every.join(end_digests(convs), KEY, "left")
    return digests.select(
        F.col("conv").alias(conv), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, x: list_reduce(list_concat([xor(a, x)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"""

ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, {{'r': r, 't': t}} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || t)) AS i
  FROM (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
lists AS (SELECT c, list(x ORDER BY i) AS s FROM turns GROUP BY c),
hashed AS (SELECT c, s, c - c % {FAMILY} AS b, {CRC_SQL} % {KINDS} AS h FROM lists),
rebuilt AS (SELECT k.c, list_concat(list_slice(coalesce(o.s, []), 1, h), list_slice(k.s, h + 1, len(k.s))) AS path FROM hashed k LEFT JOIN lists o ON k.b = o.c),
prefixes AS (SELECT c, len(path) AS size, d, list_slice(path, 1, d) AS p FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (SELECT p, d, min(c) AS conv, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '') AS ends FROM prefixes GROUP BY p, d),
children AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS children FROM nodes WHERE d > 0 GROUP BY ALL),
figures AS MATERIALIZED (
  SELECT n.*, coalesce(children, 0) AS children, CASE WHEN n.d = 0 THEN 0 ELSE (n - 1) * length(n.p[n.d].t) END AS own FROM nodes n LEFT JOIN children USING (p, d)),
below AS (SELECT list_slice(p, 1, a) AS p, a AS d, sum((children = 0)::BIGINT)::BIGINT AS leaves, sum(own)::BIGINT AS saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM figures) GROUP BY ALL)
SELECT f.conv AS conv_id, f.d AS depth, u.conv AS parent_conv_id, f.n AS n_convs, f.children AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM figures f JOIN below USING (p, d) LEFT JOIN nodes u ON u.d = f.d - 1 AND u.p = list_slice(f.p, 1, f.d - 1)
"""
