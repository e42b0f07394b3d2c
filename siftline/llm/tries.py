"""The trie of all conversation prefixes, built as a burst trie.

Equal conversations are one class first. A container holds the classes that share a head, a prefix of so many turns;
one container with the empty head holds them all. While a container has too many turns it bursts: the
turns that all its classes share become a chain of nodes, and by the next turn its classes go to smaller containers.
The other containers are dealt out to shards, sorted, and swept into nodes with a stack; one that holds a
single class has no branches and needs no sweep. What bursts have left is then summed up towards the root.

A container is named by (smallest conversation in it, depth of its head), which no other one has.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import written

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long, top_of long"
_COLUMNS = [c.split()[0] for c in NODES.split(", ")]
_BLOCK = 8192


def _counted(batches):
    """Sorted rows of a partition -> how manieth row of its conversation, within this partition, each one is."""
    last, seen = None, 0
    for x in batches:
        conv = x["conv_id"].to_numpy()
        if not len(conv):
            continue
        first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        k = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv)))) + 1
        if conv[0] == last:
            k[: first[1] if len(first) > 1 else len(k)] += seen
        last, seen = conv[-1], int(k[-1])
        yield pa.RecordBatch.from_arrays([x["conv_id"], pa.array(k), x["key"], x["chars"]], names=["conv_id", "k", "key", "chars"])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, j, key, chars: turns in order, numbered from 1, with a 128-bit name of
    (role, text) and the code points of text.

    Null turns come first; ties go by role and text, so rows that repeat each other are turns of their own. Null
    roles and texts read as empty. Rows without a conv_id belong to no conversation. Rows are ordered by ranges, so that
    a conversation with most of all rows is not one task's: a range begins with the count of the ranges before it.
    """
    spark = conversations.sparkSession
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text", "tie"]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    name = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))).alias("key")
    found = ranged.select("conv_id", name, F.length("text").cast("long").alias("chars")).mapInArrow(_counted, "conv_id long, k long, key binary, chars long")
    found = written(found.withColumn("part", F.spark_partition_id()), "trie-numbered")
    parts = found.groupBy("conv_id", "part").agg(F.max("k").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a range continues at most one conversation of the ranges before it
    before = parts.withColumn("before", before).where("before > 0").select("conv_id", "part", "before")
    return found.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("j"), "key", "chars")


def _suffix_sums(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows with `rest`: the sum of value over this and all later j of its key. A long key goes by blocks of j."""
    rows = rows.withColumn("block", F.floor(F.col("j") / _BLOCK))
    blocks = rows.groupBy(*by, "block").agg(F.sum(value).alias("later"))
    after = Window.partitionBy(*by).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("later", F.coalesce(F.sum("later").over(after), F.lit(0)))
    here = Window.partitionBy(*by, "block").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("here", F.sum(value).over(here)).join(blocks, [*by, "block"]).withColumn("rest", F.col("here") + F.col("later")).drop("block", "here", "later")


def _swept(classes: list, depth: int, top_of: int | None, parent: int | None, chars: int):
    """Nodes of one container. classes: (keys after the head, their chars, id, members); sorted, their paths are
    walked with a stack, and a node is closed when the next path leaves it."""
    classes.sort(key=lambda c: c[0])
    nodes, stack, path = [], [], []

    def opened(at: int, n_chars: int) -> None:
        # id, depth, place of the parent, members, children, leaves, saved, class that ends here, chars
        nodes.append([None, at, stack[-1] if stack else None, 0, 0, 0, 0, None, n_chars])
        stack.append(len(nodes) - 1)

    def close() -> None:
        x = nodes[stack.pop()]
        x[5] = x[5] or 1
        x[6] += (x[3] - 1) * x[8]
        if stack:
            up = nodes[stack[-1]]
            up[0] = x[0] if up[0] is None else min(up[0], x[0])
            for k, v in ((3, x[3]), (4, 1), (5, x[5]), (6, x[6])):
                up[k] += v

    opened(depth, chars)
    for keys, sizes, rep, n in classes:
        same = 0
        while same < min(len(path), len(keys)) and path[same] == keys[same]:
            same += 1
        while len(stack) > same + 1:
            close()
        for k in range(same, len(keys)):
            opened(depth + k + 1, sizes[k])
        path, x = keys, nodes[stack[-1]]
        x[0] = rep if x[0] is None else min(x[0], rep)
        x[3] += n
        x[7] = rep
    while stack:
        close()
    for i, x in enumerate(nodes):
        yield x[0], x[1], parent if not i else nodes[x[2]][0], *x[3:8], top_of if not i else None


def _sweep(batches):
    """Rows (head, depth, rep, j, ...) in that order; of each class a row with j = depth comes first."""
    container, classes, out = None, [], []

    def flush():
        if container:
            out.extend(_swept(classes, container[1], *about))

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(len(_COLUMNS))], names=_COLUMNS)

    for x in batches:
        for head, depth, rep, j, key, chars, n, top_of, parent in zip(*(x[c].to_pylist() for c in ("head", "depth", "rep", "j", "key", "chars", "n", "p_depth", "p_head"))):
            if container != (head, depth):
                flush()
                container, classes, about = (head, depth), [], (top_of, parent, chars)
            if j == depth:
                classes.append(([], [], rep, n))
            else:
                classes[-1][0].append(key)
                classes[-1][1].append(chars)
            if len(out) > 20_000:
                yield batch()
                out = []
    flush()
    if out:
        yield batch()


def _hashed(batches):
    """(rep, conv_id) in order -> rep, sha: SHA-256 of the ids of each rep, comma-joined, without holding them."""
    rep, state, done = None, None, []
    for x in batches:
        for r, c in zip(x["rep"].to_pylist(), x["conv_id"].to_pylist()):
            if r != rep:
                if state:
                    done.append((rep, state.hexdigest()))
                rep, state = r, hashlib.sha256(str(c).encode())
            else:
                state.update(b",%d" % c)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names=["rep", "sha"])
            done = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()])], names=["rep", "sha"])


def _children(n: Column, last: Column) -> Column:
    return F.when(F.col("j") == last, n).otherwise(1)


def trie(turns: DataFrame, conversations: DataFrame, container_turns: int = 20_000) -> DataFrame:
    """turns (conv_id, j, key, chars), j from 1 without gaps, and conversations (conv_id), those without turns too -> nodes.

    A node is a distinct sequence of first d keys: conv_id, its smallest member; depth; parent_conv_id (root: null);
    n_convs, members; n_children; n_leaves, childless nodes of its subtree, itself included; saved_tokens, summed over
    its subtree, each node's (n_convs - 1) * chars of its last turn; ends_sha256, SHA-256 of the ids of members that
    end here, ascending, comma-joined. Without conversations there are no nodes. conv_ids are distinct, not null.
    Containers of up to container_turns turns are swept, larger ones burst, in as many rounds as branchings lie above
    each other in containers that stay larger. The sequence of a conversation is known by its length and two 64-bit sums of hashes.
    """
    spark = turns.sparkSession
    names = turns.groupBy("conv_id").agg(F.count("*").alias("len"), F.bit_xor(F.xxhash64("j", "key")).alias("x"), F.bit_xor(F.xxhash64(F.lit("again"), "key", "j")).alias("y"))
    names = written(conversations.select("conv_id").join(names, "conv_id", "left").na.fill(0, ["len", "x", "y"]), "trie-names")
    classes = written(names.groupBy("len", "x", "y").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")), "trie-classes")
    if classes.isEmpty():
        return spark.createDataFrame([], NODES).drop("end_rep", "top_of").withColumn("ends_sha256", F.lit(""))
    members = names.join(classes.where("n > 1"), ["len", "x", "y"]).select("rep", "conv_id")
    ends = members.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rep").sortWithinPartitions("rep", "conv_id").mapInArrow(_hashed, "rep long, sha string")
    ends = ends.unionByName(classes.where("n = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("sha")))
    turns = written(turns.select(F.col("conv_id").alias("rep"), "j", "key", "chars").join(classes.select("rep"), "rep", "left_semi"), "trie-turns")

    own = ["head", "depth"]
    root = classes.agg(F.min("rep")).first()[0]
    null = F.lit(None).cast("long")
    held = classes.select("rep", "n", "len", F.lit(root).alias("head"), F.lit(0).cast("long").alias("depth"), null.alias("p_head"), null.alias("p_depth"), F.lit(0).cast("long").alias("chars"))
    single, small, bursts = [], [], []
    while True:
        size = held.groupBy(*own).agg(F.count("*").alias("n_classes"), F.sum("n").alias("n_convs"), F.sum(F.col("len") - F.col("depth")).alias("n_turns"))
        held = written(held.join(size, own), "trie-held")
        single.append(held.where("n_classes = 1"))
        small.append(held.where(f"n_classes > 1 AND n_turns <= {container_turns}"))
        held = held.where(f"n_classes > 1 AND n_turns > {container_turns}")
        if held.isEmpty():
            break
        rows = turns.withColumnRenamed("chars", "turn_chars").join(held.select("rep", *own, "n_classes"), "rep").where("j > depth")
        at = rows.groupBy(*own, "j").agg(F.count("*").alias("c"), F.min("key").alias("k0"), F.max("key").alias("k1"), F.min("turn_chars").alias("chars"), F.first("n_classes").alias("n_classes"))
        at = written(at, "trie-at")
        # the first turn that not all classes have in common
        parted = at.where("c < n_classes OR k0 <> k1").groupBy(*own).agg(F.min("j").alias("next"))
        parted = written(parted, "trie-parted")
        chain = at.join(parted, own).where("j < next").select(*own, "j", "chars")
        ended = held.join(parted, own).where("len = next - 1").select(*own, F.col("rep").alias("end_rep"))
        about = held.groupBy(*own).agg(F.first("p_head").alias("p_head"), F.first("p_depth").alias("p_depth"), F.first("chars").alias("chars"), F.first("n_convs").alias("n_convs"))
        bursts.append((written(about.join(parted, own).join(ended, own, "left"), "trie-burst"), chain))
        rows = rows.join(parted, own).where("j = next")
        heads = rows.groupBy(*own, "key").agg(F.min("rep").alias("new_head"))
        moved = rows.join(heads, [*own, "key"]).select("rep", F.col("new_head").alias("head"), F.col("next").alias("depth"), F.col("head").alias("p_head"), F.col("depth").alias("p_depth"), F.col("turn_chars").alias("chars"))
        held = classes.select("rep", "n", "len").join(moved, "rep")

    union = lambda parts: parts[0] if len(parts) == 1 else union(parts[: len(parts) // 2]).unionByName(union(parts[len(parts) // 2 :]))
    # containers with branches: sorted in their shards and swept
    small = union(small)
    heads = small.select(*own, "rep", F.col("depth").alias("j"), F.lit(None).cast("binary").alias("key"), "chars", "n", "p_depth", "p_head")
    rows = turns.join(small.select("rep", *own), "rep").where("j > depth").select(*own, "rep", "j", "key", "chars", null.alias("n"), null.alias("p_depth"), null.alias("p_head"))
    shards = heads.unionByName(rows).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *own).sortWithinPartitions(*own, "rep", "j")
    swept = shards.mapInArrow(_sweep, NODES)
    # one class: a node for each of its turns; what copies save is summed up from the end
    single = written(union(single), "trie-single")
    heads = single.select("rep", "n", "len", *own, F.col("depth").alias("j"), "chars")
    rows = turns.join(single.select("rep", "n", "len", *own), "rep").where("j > depth").select("rep", "n", "len", *own, "j", "chars").unionByName(heads)
    copied = _suffix_sums(rows.where("n > 1"), ["rep"], "chars")
    rows = rows.where("n = 1").withColumn("rest", F.lit(0).cast("long")).unionByName(copied)
    rows = rows.join(single.select("rep", "p_head", "p_depth"), "rep")
    is_top = F.col("j") == F.col("depth")
    plain = rows.select(
        F.col("rep").alias("conv_id"), F.col("j").alias("depth"), F.when(is_top, F.col("p_head")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("j") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("rest")).alias("saved_tokens"), F.when(F.col("j") == F.col("len"), F.col("rep")).alias("end_rep"), F.when(is_top, F.col("p_depth")).alias("top_of"),
    )
    nodes = [written(swept.unionByName(plain), "trie-nodes")]
    # burst containers, the deepest first: what lies below them is known by then
    for burst, chain in reversed(bursts):
        tops = union(nodes).where("top_of IS NOT NULL").groupBy(F.col("parent_conv_id").alias("head"), F.col("top_of").alias("depth")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        known = burst.join(tops, own)
        line = chain.unionByName(burst.select(*own, F.col("depth").alias("j"), "chars"))
        line = _suffix_sums(line, own, "chars").drop("chars").join(known, own)
        last = F.col("next") - 1
        nodes.append(written(line.select(
            F.col("head").alias("conv_id"), F.col("j").alias("depth"), F.when(is_top, F.col("p_head")).otherwise(F.col("head")).alias("parent_conv_id"), "n_convs", _children(F.col("kids"), last).alias("n_children"),
            "n_leaves", (F.col("below") + (F.col("n_convs") - 1) * F.col("rest")).alias("saved_tokens"), F.when(F.col("j") == last, F.col("end_rep")).alias("end_rep"), F.when(is_top, F.col("p_depth")).alias("top_of"),
        ), "trie-nodes"))
    out = union(nodes).join(ends.withColumnRenamed("rep", "end_rep"), "end_rep", "left")
    return out.drop("end_rep", "top_of").withColumnRenamed("sha", "ends_sha256").na.fill({"ends_sha256": hashlib.sha256(b"").hexdigest()})
