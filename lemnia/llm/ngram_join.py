"""Jaccard join of word-shingle sets with adaptive multi-match prefixes.

Texts with equal sets are one class, named by a hash of the set.  Two sets with similarity t or more share at least l of the
first n - ceil(t n) + l shingles of each, for any l.

A first pass looks at the prefixes (by hash) with l a tenth of the set and drops every
class that shares fewer than l of them with anything.  Of what is left, shingles that one
class alone has can't be shared, and classes of which less than t is shared by any
other drop out too.  Classes with the same shared part differ in size alone: they are
one node, as the smallest of them has every link that any has.  Nodes' shared
shingles are ordered anew, frequent ones last.  Candidate costs (the lengths of the
posting lists) are estimated, and nodes with costly prefixes lengthen them and ask
for more common shingles.  Links are then verified exactly, first against one pivot
per node and round, and at last for all candidate pairs that are still in different components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .store import Tables
from .textcore import Words, blocks, mix, shingles

WORDS, LEAST = 5, 75
#: Rows up to which a list of ids is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 500_000
STAR_ROUNDS = 2
#: Length from which a posting list of several components is handled by blocks, and what a block holds, about.
LONG_LIST, BLOCK_CLASSES, BLOCK_TOKENS = 64, 512, 150_000
#: Mean length of a prefix's posting lists beyond which the prefix is lengthened.
CHEAP = 1
#: Stands for several classes of one batch.
MANY = -(1 << 63)

POST_SCHEMA = "id long, n long, cid long, text_key long, here long, tokens array<long>"


def least_overlap(n):
    """Shingles that a set of n must share with any set it is linked to."""
    return -(-n * LEAST // 100)


def matches_needed(n):
    """l of the first pass.  Two sets share the smaller of their two, so least_overlap(n) // 10 + 1 is asked for."""
    return 1 + n // 10


def set_hash(row: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """Order-free 63-bit names of the rows' sets."""
    first = np.searchsorted(row, np.arange(n_rows + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    size = np.diff(first).astype(np.uint64)
    return (mix(sums[first[1:]] - sums[first[:-1]] + mix(size + np.uint64(77))) >> np.uint64(1)).astype(np.int64)


def _pass(batches):
    """A row per document; the first of each class of a batch holds the prefix shingles that no other class of the batch has.

    Those that several classes of the batch have are known to be shared.  Their number is the row's ``here``, and they
    are in one further row, under MANY, so a shingle is posted once a batch at most.
    """
    for batch in batches:
        ids, keys, ns, cids, toks, owners = [], [], [], [], [], []
        for part, buf, off in blocks(batch):
            row, h = shingles(Words(buf, off, lower=True), WORDS)
            n = np.bincount(row, minlength=part.num_rows)
            cid = set_hash(row, h, part.num_rows)
            ids.append(part.column("id"))
            keys.append(part.column("text_key"))
            ns.append(n)
            cids.append(cid)
            first = np.searchsorted(row, np.arange(part.num_rows))
            rank = np.arange(len(row)) - first[row]
            keep = np.zeros(part.num_rows, bool)
            keep[np.unique(cid, return_index=True)[1]] = True
            take = keep[row] & (rank < (n - least_overlap(n) + matches_needed(n))[row])
            toks.append(h[take])
            owners.append(cid[row[take]])
        if not ids:
            continue
        n, cid, tok, own = np.concatenate(ns), np.concatenate(cids), np.concatenate(toks), np.concatenate(owners)
        order = np.lexsort((own, tok))
        tok, own = tok[order], own[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])
        tok, own = tok[new], own[new]
        start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(tok)))
        many = np.repeat(size > 1, size)
        # per class, in the order of classes: how many are shared here, and the others
        names, one = np.unique(cid, return_index=True)
        here = np.zeros(len(cid), np.int64)
        here[one] = np.bincount(np.searchsorted(names, own[many]), minlength=len(names))
        alone, who = tok[~many], np.searchsorted(names, own[~many])
        order = np.argsort(one[who], kind="stable")
        count = np.zeros(len(cid) + 1, np.int64)
        count[one] = np.bincount(who, minlength=len(names))
        shared = tok[start[size > 1]]
        count[-1] = len(shared)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(np.concatenate([alone[order], shared]).view(np.int64)))
        last = lambda x: pa.array(np.append(x, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([*ids, pa.nulls(1, pa.int64())]), last(n), pa.array(np.append(cid, MANY)), pa.concat_arrays([*keys, pa.nulls(1, pa.int64())]), last(here), lists],
            ["id", "n", "cid", "text_key", "here", "tokens"],
        )


def _sets(batches):
    for batch in batches:
        for part, buf, off in blocks(batch):
            row, h = shingles(Words(buf, off, lower=True), WORDS)
            first = np.searchsorted(row, np.arange(part.num_rows + 1))
            values = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array(np.diff(first)), values], ["cid", "n", "s"])


def _alike(both: Column, na: Column, nb: Column) -> Column:
    """Whether sets of the sizes na and nb that share that many are linked."""
    return both * 100 >= LEAST * (na + nb - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both) of the pairs whose sets are similar enough, by exact intersection."""
    a = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    b = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    got = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return got.where(_alike(F.col("both"), F.col("na"), F.col("nb"))).select("a", "b", "both")


def _compare(table: pa.Table) -> pa.Table:
    """(a, b, both): links between two blocks' nodes that connect what they connect, and all links of nodes with followers.

    All intersections come from products of incidence matrices, over the
    shingles that occur twice, some thousand at a time.
    """
    cid, comp, n = table.column("cid").to_numpy(), table.column("comp").to_numpy(), table.column("n").to_numpy().astype(np.float64)
    follow = table.column("follow").to_numpy() > 0
    s = table.column("s").combine_chunks()
    row = np.repeat(np.arange(len(cid)), s.value_lengths().to_numpy())
    token = np.unique(s.flatten().to_numpy(), return_inverse=True)[1]
    count = np.bincount(token)
    keep = count[token] > 1
    row, token = row[keep], np.unique(token[keep], return_inverse=True)[1]
    first = np.argsort(token, kind="stable")
    row, token = row[first], token[first]
    both = np.zeros((len(cid), len(cid)), np.float32)
    width = 1024
    for base in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [base, base + width])
        x = np.zeros((len(cid), width), np.float32)
        x[row[a:b], token[a:b] - base] = 1
        both += x @ x.T
    near = both * 100 >= LEAST * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(near, False)
    link = near | (comp[:, None] == comp[None, :])
    label = np.arange(len(cid))
    while True:
        new = np.minimum(np.where(link, label[None, :], len(cid)).min(axis=1), label)
        new = new[new]
        if (new == label).all():
            break
        label = new
    edge = np.flatnonzero((label != np.arange(len(cid))) & (comp != comp[label]))
    a, b = np.nonzero(near & (follow[:, None] | follow[None, :]))
    a, b = np.concatenate([edge, a[a < b]]), np.concatenate([label[edge], b[a < b]])
    return pa.table({"a": cid[a], "b": cid[b], "both": both[a, b].astype(np.int64)})


def _compare_blocks(posts: DataFrame, sets: DataFrame, tables: Tables) -> DataFrame:
    """Links (a, b, both) among nodes that long posting lists of several components connect.

    Their clusters are cut into blocks of a bounded size by hash, and every two
    blocks that hold different components meet in a task.
    """
    first = _side(posts.groupBy("token").agg(F.min("cid").alias("b")), tables, "firsts")
    stars = posts.select("token", "cid").join(first, "token").select(F.col("cid").alias("a"), "b").distinct()
    cluster = connected(stars, tables, "clusters").withColumnRenamed("comp", "cluster")
    member = posts.groupBy("cid").agg(F.max("comp").alias("comp"), F.max("n").alias("n")).join(cluster, "cid")
    member = tables.write(member, "members")
    per = member.groupBy("cluster", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    main = per.groupBy("cluster").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("mc"), F.max_by("t", F.struct("c", "comp")).alias("mt"), F.sum("c").alias("c"), F.sum("t").alias("t"), F.count("*").alias("comps")).where("comps > 1")
    main = main.select("cluster", "main", F.greatest(F.ceil(F.col("mc") / BLOCK_CLASSES), F.ceil(F.col("mt") / BLOCK_TOKENS)).cast("int").alias("k"), F.greatest(F.ceil((F.col("c") - F.col("mc")) / BLOCK_CLASSES), F.ceil((F.col("t") - F.col("mt")) / BLOCK_TOKENS)).cast("int").alias("m"))
    main = _side(main, tables, "mains")
    # blocks 0 .. k-1 are of the cluster's largest component, k .. k+m-1 of the others
    h = F.xxhash64("cid", F.lit(99))
    placed = member.join(main, "cluster").withColumn("x", F.when(F.col("comp") == F.col("main"), F.pmod(h, F.col("k"))).otherwise(F.col("k") + F.pmod(h, F.col("m"))))
    meets = placed.withColumn("y", F.explode(F.when(F.col("x") < F.col("k"), F.sequence(F.col("k").cast("bigint"), (F.col("k") + F.col("m") - 1).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), (F.col("k") + F.col("m") - 1).cast("bigint")))))
    meets = meets.select("cid", "comp", "cluster", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    return meets.join(sets, "cid").select("cluster", "i", "j", "cid", "comp", "n", "follow", "s").groupBy("cluster", "i", "j").applyInArrow(_compare, "a long, b long, both long")


def _side(df: DataFrame, tables: Tables, name: str) -> DataFrame:
    """A written table to join with: broadcast where it is short, so that what it meets stays where it is, hot shingles too."""
    table = tables.write(df, name)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _left(picked: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """((id, n, cid, text_key) per row, (cid, n, s) of the classes that share enough prefix shingles to be linked to anything)."""
    posted = tables.write(picked.mapInArrow(_pass, POST_SCHEMA), "posted")
    rows = tables.write(posted.where(F.col("cid") != MANY).select("id", "n", "cid", "text_key"), "rows")
    # dealt by shingle once, for the counts and for the way back to the classes; so neither may be filtered alone
    posts = posted.where(F.size("tokens") > 0).select("cid", F.explode("tokens").alias("token")).where("token is not null").repartition("token")
    shared = posts.groupBy("token").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where((F.col("lo") != F.col("hi")) | (F.col("lo") == MANY)).select("token")
    found = posts.join(shared.hint("shuffle_hash"), "token").groupBy("cid").agg(F.count("*").alias("found"))
    # each batch with the class counts all its shared shingles, so their sum is a multiple of it
    per_class = posted.where(F.col("n") > 0).groupBy("cid").agg(F.min("text_key").alias("text_key"), F.max("n").alias("n"), F.sum("here").alias("here"), F.sum(F.when((F.col("here") > 0) | (F.size("tokens") > 0), 1).otherwise(0)).alias("batches"))
    enough = F.col("here") + F.coalesce("found", F.lit(0)) >= F.col("batches") * (1 + F.floor(F.ceil(F.col("n") * LEAST / 100) / 10))
    left = tables.write(per_class.join(found, "cid", "left").where(enough).select("cid", "text_key"), "left")
    tables.drop("posted")
    few = left.count() <= BROADCAST_ROWS  # two numbers a row
    chosen = picked.join(F.broadcast(left) if few else left, "text_key").select("cid", "text")
    sets = chosen.mapInArrow(_sets, "cid long, n long, s array<long>")
    if rows.groupBy("text_key").count().where("count > 1").limit(1).count():  # rows that are repeated as they are
        sets = sets.dropDuplicates(["cid"])
    return rows, tables.write(sets, "sets")


def _nodes(sets: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((cid, n, s, follow) of the nodes, links (a, b) of classes to their nodes, followers (cid, n, leader)).

    s: the shingles that other classes have too, rare ones first; what two classes
    share is in both.  Of the classes with one shared part E, the smallest is linked to
    b if |E| suffices for their sizes, and to all that the others could be linked to but
    for those too large for |E|.  The smallest of these is a second node.  The
    others follow it: they are linked only to what it is linked to, if they aren't too large.
    """
    tokens = sets.select("cid", "n", F.explode("s").alias("token"))
    side = _side(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), tables, "shared")
    k = F.size("s").cast("long")
    parts = tokens.join(side, "token").groupBy("cid").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("s"))
    parts = tables.write(parts.where(100 * k >= LEAST * F.col("n")).withColumn("part", F.xxhash64("s")), "parts")
    first = parts.groupBy("part").agg(F.min(F.struct("n", "cid")).alias("first"))
    of = parts.select("cid", "n", "part", k.alias("k")).join(first, "part")
    near = _alike(F.col("k"), F.col("n"), F.col("first.n"))
    apart = tables.write(of.where(~near & (F.col("cid") != F.col("first.cid"))).select("cid", "n", "part"), "apart")
    leads = apart.groupBy("part").agg(F.min(F.struct("n", "cid"))["cid"].alias("leader"), (F.count("*") - 1).alias("follow"))
    followers = apart.join(leads, "part").where(F.col("cid") != F.col("leader")).select("cid", "n", "leader")
    attached = of.where(near & (F.col("cid") != F.col("first.cid"))).select(F.col("cid").alias("a"), F.col("first.cid").alias("b"))
    ends = first.select(F.col("first.cid").alias("cid"), F.lit(0).cast("long").alias("follow")).unionByName(leads.select(F.col("leader").alias("cid"), "follow"))
    nodes = tables.write(parts.select("cid", "n", "s").join(ends, "cid"), "nodes")
    return nodes, tables.write(attached, "attached"), tables.write(followers, "followers")


def _posts(nodes: DataFrame, tables: Tables) -> DataFrame:
    """(token, cid, n, l, follow, df) of the lengthened prefixes, where a list has two nodes or more."""
    n, size = F.col("n"), F.size("s")
    plain = size - F.ceil(n * LEAST / 100) + 1
    prefix = lambda frame, length: frame.select("cid", "n", "l", "follow", F.explode(F.slice("s", F.lit(1), length.cast("int"))).alias("token"))
    short = prefix(nodes.withColumn("l", F.lit(1)), plain)
    lists = lambda frame, name: _side(frame.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), tables, name)
    # the cost of a prefix is the sum of its posting lists' lengths
    costs = tables.write(short.join(lists(short, "lists"), "token").groupBy("cid").agg(F.sum("df").alias("cost")), "costs")
    # an l of a twentieth of the set at least where anything is shared, of a tenth where lists are long
    more = F.when(F.col("cost") > CHEAP * plain, F.floor(n / 10)).otherwise(F.floor(n / 20))
    long_ = prefix(nodes.join(costs, "cid").withColumn("l", (1 + more).cast("int")), plain + F.col("l") - 1)
    return tables.write(long_.join(lists(long_, "long_lists"), "token").select("token", "cid", "n", "l", "follow", "df"), "posts")


def _links(nodes: DataFrame, tables: Tables) -> DataFrame:
    """(a, b, both) that connect all linked nodes, with all links of nodes that others follow."""
    n = F.col("n")
    posts = _posts(nodes, tables)
    # stars: every node against one pivot a round, that it meets in the most lists and is not linked to yet
    links = None
    for k in range(STAR_ROUNDS):
        named = posts.withColumn("comp", F.col("cid")) if links is None else posts.join(links.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        order = F.xxhash64("cid", F.lit(k))
        pivots = named.groupBy("token").agg(F.min_by(F.struct("cid", "comp", "n"), order).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        pivots = _side(pivots, tables, f"pivots{k}")
        size_fits = (F.col("p.n") * 100 >= LEAST * n) & (n * 100 >= LEAST * F.col("p.n"))
        votes = named.join(pivots, "token").where((F.col("p.comp") != F.col("comp")) & size_fits).groupBy("cid", F.col("p.cid").alias("b")).agg(F.count("*").alias("v"))
        pairs = votes.groupBy("cid").agg(F.max_by("b", F.struct("v", "b")).alias("b")).select(F.col("cid").alias("a"), "b")
        new = tables.write(_verified(pairs, nodes), f"star{k}")
        links = new if links is None else links.unionByName(new)
    comp = connected(links.select("a", "b"), tables, "stars")
    # all candidate pairs left between components; a node that others follow is taken for a component of its own
    named = posts.join(comp, "cid", "left").withColumn("comp", F.when(F.col("follow") > 0, -1 - F.col("cid")).otherwise(F.coalesce("comp", "cid")))
    mixed = named.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    open_ = tables.write(named.join(_side(mixed, tables, "mixed"), "token"), "open")
    # lists that many nodes of several components share are compared in blocks; in others, what is outside of the list's
    # largest component meets the whole list
    long_ = open_.where(F.col("df") > LONG_LIST)
    dense = _compare_blocks(long_, nodes, tables) if long_.head(1) else None
    short = open_.where(F.col("df") <= LONG_LIST)
    a = short.where("comp <> main").select("token", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("l").alias("la"))
    b = short.select("token", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("l").alias("lb"), "main")
    rest = a.join(b, "token").where("ca <> cb and (cb = main or a < b)").where((F.col("na") * 100 >= LEAST * F.col("nb")) & (F.col("nb") * 100 >= LEAST * F.col("na")))
    met = rest.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("v"), F.max(F.least("la", "lb")).alias("l"))
    # of a pair's common shingles those in long lists are not counted here; blocks see all pairs that share one of them
    rest = tables.write(met.where("v >= l").select("a", "b"), "pairs")
    new = _verified(rest, nodes)
    new = tables.write(new if dense is None else new.unionByName(dense), "rest")
    return links.unionByName(new)


def classes_and_links(docs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """((id, n, cid) per row, (cid, comp) of the linked classes)."""
    picked = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # an id may be null or on several texts, so a class finds its text by a key of both
    picked = picked.withColumn("text_key", F.xxhash64("id", F.col("id").isNull(), "text"))
    rows, sets = _left(picked, tables)
    nodes, attached, followers = _nodes(sets, tables)
    tables.drop("sets", "shared", "parts")
    links = _links(nodes, tables)
    # followers are linked to what their leaders are linked to, where their own sizes allow it
    both_ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "both"))
    sizes = nodes.select(F.col("cid").alias("b"), F.col("n").alias("nb"))
    following = followers.join(both_ways.withColumnRenamed("a", "leader"), "leader").join(sizes, "b").where(_alike(F.col("both"), F.col("n"), F.col("nb"))).select(F.col("cid").alias("a"), "b")
    every = links.select("a", "b").unionByName(attached).unionByName(following)
    return rows.select("id", "n", "cid"), connected(every, tables, "all")


def join_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id).

    Texts are lowered in A-Z and cut at white space; fewer than five words are
    one shingle.  Null, empty and blank texts have no shingle and are linked
    with nothing.  component_id is the least doc_id reachable; rows with equal
    sets are always linked.  Sets are compared by 64-bit shingle hashes.
    """
    tables = Tables(docs.sparkSession, "ngram")
    rows, comp = classes_and_links(docs, tables)
    named = rows.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = rows.where("n > 0").groupBy("cid").agg(F.min("id").alias("id")).join(comp, "cid", "left").groupBy(F.coalesce("comp", "cid").alias("comp")).agg(F.min("id").alias("component_id"))
    alone = named.where("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return named.where("n > 0").join(least, "comp").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
