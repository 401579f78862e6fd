"""A prefix trie of conversations by fixed-length block hashing, with what sharing prefixes saves.

A turn is digested once, with its depth; a block's digest is the exclusive or of its ``BLOCK`` turns' digests, and a prefix's that of its blocks: parts of a conversation of any
length are digested apart and joined afterwards (``operators.running``), so that no task holds a conversation. Conversations are grouped by whole blocks first: by the digest
before a block and the one after it. Below a prefix after which there is one block only, a full one, siblings don't diverge: its turns' nodes follow from the block at
once. Only other blocks, each once however many conversations have it, are refined turn by turn.

What a subtree holds is summed without walking it. A node belongs to its smallest member; the nodes of a conversation are the end of its path. So each conversation brings
what its own nodes save, and whether it ends in a leaf, to every block on its path, and from a node's sum only what its owner has above the node is taken off.

Digests are 128 bits, and different prefixes are held to differ by them. Defined results: rows without a conv_id belong to no conversation; a null turn comes first, and turns of
one number are in the order of their digests, repeated rows each counted; null role or text becomes empty; c % 20 has the sign of c; where the conversation that lends its first
turns is absent or short, its turns count as far as there are any; a conversation without turns ends in the root; other columns aren't read; an empty table has no root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.llm.skew import spread_join
from planmatch.llm.storage import cut, cut_for_joins
from planmatch.operators.running import XOR, running

#: Turns of a block, and turns that a conversation takes over from another at most.
BLOCK, MOST_SHARED = 4, 3
#: Conversations whose ids are joined to one text at once.
CHUNK = 512
NODE = ["depth", "lo", "hi"]


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), lo, hi (digests), words of every turn, without its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("lo"), F.xxhash64(F.lit(2), text, role).alias("hi"), words(text).alias("words"), F.monotonically_increasing_id().alias("place")
    ).filter("conv_id is not null")
    return running(slim, ["conv_id"], ["turn", "lo", "hi", "place"], {"pos": F.lit(1)}).select("conv_id", "pos", "lo", "hi", "words")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, depth, lo, hi, words of conversations that begin with turns of another, and conv_id of all of them."""
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(MOST_SHARED + 1)).cast("int")
    lender = F.col("conv_id") - F.col("conv_id") % 20
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = cut(convs.select("conv_id", "n", taken.alias("taken"), lender.alias("lender")))
    first = own.filter((F.col("conv_id") % 20 == 0) & (F.col("pos") <= MOST_SHARED)).withColumnRenamed("conv_id", "lender")
    # twenty conversations at most have one lender
    lent = convs.filter("taken > 0").select("conv_id", "taken", "lender").join(first, "lender").filter("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "lo", "hi", "words")
    lengths = convs.filter("conv_id % 20 = 0").select(F.col("conv_id").alias("lender"), F.col("n").alias("there"))
    short = convs.filter("taken > 0").join(lengths, "lender", "left").select("conv_id", (F.col("taken") - F.least("taken", F.coalesce("there", F.lit(0)))).alias("short")).filter("short > 0")
    rest = spread_join(own.filter(F.col("pos") > taken), cut(short), "conv_id", "left")
    rest = rest.select("conv_id", (F.col("pos") - F.coalesce("short", F.lit(0))).alias("depth"), "lo", "hi", "words")
    return lent.unionByName(rest), convs.select("conv_id")


def blocks(turned: DataFrame, size: int) -> DataFrame:
    """conv_id, k, n (turns), before_lo, before_hi, after_lo, after_hi, and digests and words of each place: lo_i, hi_i, words_i."""
    at = F.col("depth") - 1
    z = turned.select("conv_id", F.floor(at / size).cast("long").alias("k"), (at % size).alias("i"), F.xxhash64(F.lit(3), "lo", "hi", "depth").alias("lo"), F.xxhash64(F.lit(4), "hi", "lo", "depth").alias("hi"), "words")
    place = [F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}_{i}") for i in range(size) for c in ("lo", "hi", "words")]
    each = z.groupBy("conv_id", "k").agg(F.count("*").alias("n"), F.bit_xor("lo").alias("lo"), F.bit_xor("hi").alias("hi"), *place)
    out = running(each, ["conv_id"], ["k"], {"after_lo": F.col("lo"), "after_hi": F.col("hi")}, XOR)
    return out.withColumns({f"before_{c}": F.col(c).bitwiseXOR(F.col(f"after_{c}")) for c in ("lo", "hi")})


def distinct_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of different content or place, each once: n_convs, conv_id (the smallest), and whether siblings diverge in it."""
    own = [f"{c}_{i}" for i in range(size) for c in ("lo", "hi", "words")]
    key = ["k", "before_lo", "before_hi", "after_lo", "after_hi"]
    each = cut_for_joins(rows.groupBy(*key).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in own]))
    each = each.withColumn("parent", F.struct("k", "before_lo", "before_hi"))
    alone = each.groupBy("parent").agg(F.count("*").alias("c"), F.min("n").alias("n")).filter(F.col("c") == 1).filter(F.col("n") == size).select("parent", F.lit(False).alias("diverge"))
    return spread_join(each, alone, "parent", "left").drop("parent").withColumn("diverge", F.coalesce("diverge", F.lit(True)))


def refined(each: DataFrame, size: int, measures: dict[str, Column]) -> DataFrame:
    """NODE, parent_lo, parent_hi and ``measures`` (aggregates of a block's columns of these names) of every node that has a turn: of blocks in which
    siblings don't diverge as they are, of others by turn."""
    lo, hi = F.col("before_lo"), F.col("before_hi")
    nodes = []
    for i in range(size):
        below = lo.bitwiseXOR(F.col(f"lo_{i}")), hi.bitwiseXOR(F.col(f"hi_{i}"))
        node = F.struct((F.col("k") * size + i + 1).alias("depth"), below[0].alias("lo"), below[1].alias("hi"), lo.alias("parent_lo"), hi.alias("parent_hi"), F.col(f"words_{i}").alias("words"))
        nodes.append(F.when(F.col("n") > i, node))
        lo, hi = below
    given = [c for c in measures if c != "words"]
    one = each.select("diverge", *given, F.explode(F.array_compact(F.array(*nodes))).alias("node")).select("diverge", *given, "node.*")
    by = [*NODE, "parent_lo", "parent_hi"]
    return one.filter("not diverge").select(*by, *measures).unionByName(one.filter("diverge").groupBy(*by).agg(*[m.alias(c) for c, m in measures.items()]))


def ends(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """NODE and ends_sha256 of the nodes in which conversations end: ids in ascending order, some at a time, however many one node has."""
    last = rows.groupBy("conv_id").agg(F.sum("n").alias("depth"), F.bit_xor("lo").alias("lo"), F.bit_xor("hi").alias("hi"))
    last = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in NODE])
    chunk = F.floor(F.col("conv_id") / CHUNK).cast("long")
    # conv_ids are distinct here: a chunk has CHUNK of them at most
    some = last.groupBy(*NODE, chunk.alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    schema = pa.schema([*[(c, pa.int64()) for c in NODE], ("ends_sha256", pa.string())])

    def digest(batches):
        node, sha = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if key != node:
                    if node is not None:
                        done.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*node, sha.hexdigest()), schema)], schema=schema)

    return some.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").mapInArrow(digest, "depth long, lo long, hi long, ends_sha256 string")


def trie(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turned, convs = rebuilt(turns(conversations))
    rows = cut_for_joins(blocks(turned, size))
    each = cut_for_joins(distinct_blocks(rows, size))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    nodes = refined(each, size, {"n_convs": F.sum("n_convs"), "conv_id": F.min("conv_id"), "words": F.first("words")})
    nodes = nodes.unionByName(root.select(*[zero.alias(c) for c in NODE], F.lit(None).cast("long").alias("parent_lo"), F.lit(None).cast("long").alias("parent_hi"), "n_convs", "conv_id", zero.alias("words")))
    # what a node saves itself, and with those of its owner above it
    nodes = running(nodes, ["conv_id"], ["depth"], {"upto": (F.col("n_convs") - 1) * F.col("words")})
    nodes = cut_for_joins(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words")))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_lo").alias("lo"), F.col("parent_hi").alias("hi")).agg(F.count("*").alias("n_children"))
    nodes = cut_for_joins(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)))
    # each owner's savings, and whether it ends in a leaf, go to all blocks on its path
    brought = nodes.groupBy("conv_id").agg(F.sum("own").alias("saved"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaves")).filter("saved > 0 or leaves > 0")
    brought = cut_for_joins(brought)
    block = ["k", "after_lo", "after_hi"]
    on_path = spread_join(rows.select("conv_id", *block), brought, "conv_id").groupBy(*block).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    sums = refined(each.join(on_path, block), size, {"saved": F.sum("saved"), "leaves": F.sum("leaves")}).select(*NODE, "saved", "leaves")
    sums = sums.unionByName(brought.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).filter("leaves is not null").select(*[zero.alias(c) for c in NODE], "saved", "leaves"))
    above = nodes.select(F.struct(*NODE).alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, NODE).join(ends(convs, rows), NODE, "left")
    out = out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), F.col("parent_lo").alias("lo"), F.col("parent_hi").alias("hi"))).alias("parent"), "n_convs", "n_children",
                     F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("upto") + F.col("own")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    out = cut_for_joins(out)
    return spread_join(out, above, "parent", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
with recursive tab as (select list(v order by i) as t from (select i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as v
    from (select unnest(range(256))::bigint as i))),
own as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) as pos, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
conv as (select conv_id, conv_id - conv_id % 20 as lender, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8)), 4294967295) % 4 as h from (select distinct conv_id from own), tab),
lent as (select conv.conv_id, pos, role, text from conv join own on own.conv_id = lender where pos <= h),
turned as (select conv_id, row_number() over (partition by conv_id order by part, pos) as depth, role, text from
    (select conv_id, 0 as part, pos, role, text from lent union all select own.conv_id, 1, pos, role, text from own join conv on own.conv_id = conv.conv_id where pos > h)),
path as (select conv_id, depth, md5(array_to_string(list(md5(length(role)::varchar || ':' || role || text)) over (partition by conv_id order by depth), ',')) as node,
    len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) as w from turned
    union all select conv_id, 0, '', 0 from conv),
step as (select *, lag(node) over (partition by conv_id order by depth) as parent from path),
node as (select depth, node, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n, (count(*) - 1) * any_value(w) as own from step group by depth, node),
kids as (select depth - 1 as depth, parent as node, count(*) as c from node where depth > 0 group by all),
below as (select u.depth, u.node, sum(v.own) as saved, count(*) filter (where kids.c is null) as leaves from node v join path u on u.conv_id = v.conv_id and u.depth <= v.depth
    left join kids on kids.depth = v.depth and kids.node = v.node group by u.depth, u.node),
ended as (select depth, node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as sha from (select conv_id, max(depth) as depth, max_by(node, depth) as node from path group by conv_id) group by depth, node)
select node.conv_id, node.depth::bigint as depth, up.conv_id as parent_conv_id, node.n::bigint as n_convs, coalesce(kids.c, 0)::bigint as n_children, below.leaves::bigint as n_leaves, below.saved::bigint as saved_tokens,
    coalesce(sha, sha256('')) as ends_sha256
from node join below using (depth, node) left join kids using (depth, node) left join ended using (depth, node) left join node up on up.depth = node.depth - 1 and up.node = node.parent
"""
