"""N-gram Jaccard join through a token-group matrix, exact.

A document is the set of its distinct word shingles, as 64-bit hashes. Documents of equal sets form a class, and only
classes are compared. Two classes are linked when the Jaccard similarity of their sets is at least num / den.

In any one order of all tokens, two linked sets have a token in common among the first ``n - ceil(n num / den) + 1`` of
each (the prefix), and their sizes lie in the same size class or in neighbouring ones. The order puts rare tokens first:
a passage that many documents share, or a common line, is in a prefix only where a document has little else. Similar
classes are partitioned into groups around seeds: a group is of one size class, and its members share prefix tokens.

First every query is compared with the seeds of its prefix tokens, one comparison for each, and the connected components
of these links are found. A token whose holders are all of one component then leads nowhere; where a family of near
copies is connected through its seed, its groups stay closed. For the others the token-group matrix holds the union
of each group's counted tokens. Of a query's counted tokens, those that the union lacks are in no member of the group; if
they are more than a linked set may lack, the group stays closed to the query. What still qualifies is opened: blocks of
queries meet blocks of members, a task for each two blocks, and a product of their token matrices gives the overlaps of
all pairs at once; links that add nothing to what the block has connected aren't given. So no row stands for a pair, and
no link between components is lost. There is no cap on groups, partners or candidates. Whole sets are made anew from
the texts, of only those classes that are compared.

Where counts come from: a token whose hash lies in the lowest ``share`` of all hashes belongs to the counted
universe; every document's tokens in it are counted, over all documents. Universe tokens come first in the order, by
count and then hash, and the others follow by hash. Prefixes nearly always lie inside the universe; where one
doesn't (small sets), it goes on with the others, and the join is exact all the same.

Joins on a token or a seed that many classes have are of many rows to one, which Spark's adaptive execution splits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.components import components
from lexiloom.llm.shared import documents, forget, staged

_SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What identifies a class: the size of its set, the set's hash, and its least and greatest token.
_KEY = ["n", "h", "lo", "hi"]
#: Up to so many classes (four numbers each, a relation of about 40 MB) are sent to all executors to find their texts;
#: beyond, these are found by a shuffle.
SENT_ROWS = 500_000


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; linked at a similarity of num / den or more."""

    words: int = 5
    num: int = 80
    den: int = 100

    @property
    def share(self) -> float:
        """The counted part of all tokens: prefixes take 1 - num / den of a set, and some slack."""
        return min(1.0, 1.6 * (self.den - self.num) / self.den)

    @property
    def bound(self) -> int:
        """Hashes below this are in the counted universe."""
        return -(1 << 63) + min((1 << 64) - 1, int(self.share * (1 << 64)))

    def size_class(self, n: Column) -> Column:
        """Linked sets are of one class or of neighbouring ones; classes are a hair wider than num / den asks for."""
        return F.floor(F.ln(n.cast("double")) / (math.log(self.den / self.num) * (1 + 1e-9))).cast("int")

    @property
    def least(self) -> int:
        """The size below which a set is linked with no other."""
        return -(-self.num // (self.den - self.num))


def with_set(df: DataFrame, words: int, text: str = "text") -> DataFrame:
    """df with ``_set``, the sorted hashes of the distinct shingles: A-Z in lower case; of fewer words the whole
    sequence is one shingle; null or no words give an empty set."""
    trimmed = F.btrim(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(_SPACES))
    split = df.withColumn("_words", F.when(F.length(trimmed) > 0, F.split(trimmed, _SPACE)).otherwise(F.array().cast("array<string>")))
    run = F.transform(F.sequence(F.lit(0), F.size("_words") - words), lambda i: F.xxhash64(*[F.get(F.col("_words"), i + j) for j in range(words)]))
    whole = F.array(F.xxhash64(F.lit(words), F.array_join("_words", " ")))
    hashed = F.when(F.size("_words") >= words, run).when(F.size("_words") > 0, whole).otherwise(F.array().cast("array<long>"))
    return split.withColumn("_hashes", hashed).withColumn("_set", F.sort_array(F.array_distinct("_hashes"))).drop("_words", "_hashes")


def _keys() -> list[Column]:
    """The columns of _KEY, from _set."""
    return [F.size("_set").cast("long").alias("n"), F.xxhash64("_set").alias("h"), F.get("_set", F.lit(0)).alias("lo"), F.get("_set", F.size("_set") - 1).alias("hi")]


def _needed(n: Column, rule: Rule) -> Column:
    """Tokens that a set of n shares at least with any set that it is linked with."""
    return F.ceil(n * rule.num / F.lit(rule.den)).cast("long")


def _overlap(a: Column, b: Column, rule: Rule) -> Column:
    """Tokens that linked sets of sizes a and b share at least."""
    return F.ceil((a + b) * rule.num / F.lit(rule.num + rule.den)).cast("long")


class _Join:
    def __init__(self, docs: DataFrame, rule: Rule) -> None:
        """docs has doc_id (long) and text."""
        self.docs, self.rule = docs, rule
        counted = F.size(F.filter("_set", lambda x: x < F.lit(rule.bound)))
        prefix = F.col("n") - _needed(F.col("n"), rule) + 1
        keyed = with_set(docs, rule.words).select("doc_id", F.xxhash64("text").alias("t"), "_set", *_keys()).withColumn("_counted", counted)
        linkable = F.when(F.col("n") >= rule.least, F.slice("_set", F.lit(1), F.greatest(F.col("_counted"), prefix.cast("int"))))
        first = staged(keyed.select("doc_id", "t", *_KEY, "_counted", linkable.alias("sketch")), "sketches")
        self.members = staged(first.select("doc_id", *_KEY), "members")
        # a class for each set; copies are merged before they are shuffled
        # the class's text is known by its least doc_id and its hash: doc_ids may be null or repeat with other texts
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t"))
        merged = first.where("n > 0").groupBy(*_KEY).agg(least.alias("least"), F.first("_counted").alias("counted"), F.first("sketch").alias("sketch"))
        self.classes = staged(merged.select(*_KEY, F.col("least.doc_id").alias("low"), F.col("least.t").alias("t"), "counted", "sketch", F.monotonically_increasing_id().alias("node")), "classes")
        forget(first)

    def postings(self) -> DataFrame:
        """Prefix tokens that more than one class has in its sketch: (node, n, counted sketch part, tokens)."""
        rule = self.rule
        tokens = self.classes.where("sketch is not null").select("node", F.explode("sketch").alias("token"))
        counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select(F.col("token").alias("_token"), "df")
        shared = tokens.join(counts, F.col("token") == F.col("_token"))
        # universe tokens by count, then the others; of equal count by hash
        rank = F.struct((F.col("token") >= F.lit(rule.bound)).alias("late"), F.when(F.col("token") < F.lit(rule.bound), F.col("df")).otherwise(0).alias("df"), "token")
        lists = shared.groupBy("node").agg(F.sort_array(F.collect_list(rank)).alias("shared")).select(F.col("node").alias("_node"), "shared")
        prefix = F.col("n") - _needed(F.col("n"), rule) + 1
        alone = F.size("sketch") - F.size("shared")  # tokens of one class only come first, and lead nowhere
        taken = F.when(F.col("counted") <= prefix, F.size("shared")).otherwise(F.greatest(F.lit(0), prefix - alone)).cast("int")
        found = self.classes.join(lists, F.col("node") == F.col("_node")).withColumn("tokens", F.slice("shared", F.lit(1), taken)["token"])
        return staged(found.where(F.size("tokens") > 0).select("node", "low", "t", *_KEY, F.slice("sketch", F.lit(1), F.col("counted")).alias("part"), "tokens"), "prefixes")

    def linked(self, pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
        """Those of the pairs (a, b), each once, that are linked."""
        rule = self.rule
        one = prefixes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("part").alias("part_a"))
        two = prefixes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("part").alias("part_b"))
        # sizes first, without the parts
        sizes = [x.drop("part_a", "part_b") for x in (one, two)]
        sized = pairs.join(sizes[0], "a").join(sizes[1], "b").where(F.least("n_a", "n_b") * rule.den >= F.greatest("n_a", "n_b") * rule.num)
        sized = sized.join(one.select("a", "part_a"), "a").join(two.select("b", "part_b"), "b")
        need = _overlap(F.col("n_a"), F.col("n_b"), rule)
        common = F.size(F.array_intersect("part_a", "part_b"))
        # universe tokens of one that the other lacks are missing from the overlap
        possible = F.least(F.col("n_a") - F.size("part_a"), F.col("n_b") - F.size("part_b")) + common
        close = staged(sized.where(possible >= need).select("a", "b", "n_a", "n_b"), "close")
        sets = self.whole_sets(prefixes, close.select(F.explode(F.array("a", "b")).alias("node")))
        # sets are never small: merged at every size
        both = close.join(sets.select(F.col("node").alias("a"), F.col("_set").alias("set_a")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("_set").alias("set_b")).hint("merge"), "b")
        common = F.size(F.array_intersect("set_a", "set_b"))
        out = staged(both.withColumn("common", common).where(F.col("common") * rule.den >= (F.col("n_a") + F.col("n_b") - F.col("common")) * rule.num).select("a", "b"), "seed-links")
        forget(close, sets)
        return out

    def whole_sets(self, prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
        """(node, _set) of these nodes, from the text of their first documents; repeats among the nodes don't matter."""
        wanted = nodes.select(F.col("node").alias("_node")).distinct()
        named = staged(prefixes.join(wanted, F.col("node") == F.col("_node"), "left_semi").select("node", "low", "t", F.col("n").alias("_n"), F.col("h").alias("_h")), "wanted")
        few = F.broadcast(named) if named.count() <= SENT_ROWS else named
        # stored before it is filtered: a filter on the key would be pushed into the making of the sets
        made = staged(with_set(self.docs.join(few, F.col("doc_id").eqNullSafe(F.col("low")) & (F.xxhash64("text") == F.col("t"))), self.rule.words).select("node", "_set", *_keys()[:2], "_n", "_h"), "sets")
        out = made.where((F.col("n") == F.col("_n")) & (F.col("h") == F.col("_h"))).select("node", "_set")
        # rows that repeat give a class's set more than once
        found = out.agg(F.count("*"), F.count_distinct("node")).first()
        return out if found[0] == found[1] else out.dropDuplicates(["node"])


#: Tokens, and sets, of the members of a group, and of its queries, that are compared at once; tokens of a slice of their matrix;
#: queries whose overlaps are judged at once.
BLOCK_TOKENS, BLOCK_SETS, SLICE, STRIP = 400_000, 4_000, 2_048, 256


def _spanning(rule: Rule) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Compares the queries of a block with the members of a block of the group, and gives links that connect whatever
    is linked and not yet of one component: fewer than the rows of the block, however many pairs are linked."""

    def matrix(sets: list[np.ndarray], tokens: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(tokens)), dtype=np.float32)
        for i, x in enumerate(sets):
            at = np.searchsorted(tokens, x)
            at[at == len(tokens)] = 0
            out[i, at[tokens[at] == x]] = 1.0
        return out

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["query"].to_numpy(dtype=bool)
        q, m = frame[asks], frame[~asks]
        q_sets, m_sets = ([np.asarray(x, dtype=np.int64) for x in f["_set"]] for f in (q, m))
        found: list[tuple[int, int]] = []
        if len(q) and len(m):
            tokens = np.intersect1d(np.concatenate(q_sets), np.concatenate(m_sets))
            common = np.zeros((len(q), len(m)), dtype=np.float32)
            for a in range(0, len(tokens), SLICE):
                common += matrix(q_sets, tokens[a : a + SLICE]) @ matrix(m_sets, tokens[a : a + SLICE]).T
            q_sizes, m_sizes = (np.array([len(x) for x in sets]) for sets in (q_sets, m_sets))
            linked = np.zeros(common.shape, dtype=bool)
            for a in range(0, len(q), STRIP):
                whole = np.rint(common[a : a + STRIP]).astype(np.int64)
                linked[a : a + STRIP] = whole * rule.den >= (q_sizes[a : a + STRIP, None] + m_sizes[None, :] - whole) * rule.num
            del common
            roots, parent = m["root"].to_numpy(), {}

            def find(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            nodes = m["node"].to_numpy()
            for i, (node, root) in enumerate(zip(q["node"].tolist(), q["root"].tolist(), strict=True)):
                for r, j in zip(*np.unique(roots[linked[i]], return_index=True), strict=True):
                    one, other = find(root), find(int(r))
                    if one != other:
                        parent[max(one, other)] = min(one, other)
                        found.append((node, int(nodes[linked[i]][j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _opened(queries: DataFrame, members: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links between the queries (node, grp, root, n) of groups and the groups' members (node, grp, root, n).

    A group's queries and members are dealt into blocks of about BLOCK_TOKENS or BLOCK_SETS, and each block of queries meets each block
    of members in one task: no task holds a whole group.
    """
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_SETS)).cast("int")
    asked = queries.groupBy("grp").agg(blocks.alias("q_blocks"))
    held = members.groupBy("grp").agg(blocks.alias("m_blocks"))
    shape = staged(asked.join(held, "grp").select(F.col("grp").alias("_grp"), "q_blocks", "m_blocks"), "shape")
    q = queries.join(shape, F.col("grp") == F.col("_grp")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("q_blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)))
    m = members.join(shape, F.col("grp") == F.col("_grp")).withColumn("j", F.pmod(F.xxhash64("node"), F.col("m_blocks"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
    columns = ["grp", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "node", "root"]
    rows = q.select(*columns, F.lit(True).alias("query")).unionByName(m.select(*columns, F.lit(False).alias("query")))
    whole = rows.join(sets.select(F.col("node").alias("_node"), "_set").hint("merge"), F.col("node") == F.col("_node")).drop("_node")
    return staged(whole.groupBy("grp", "i", "j").applyInPandas(_spanning(rule), "a long, b long"), "links-of-blocks")


def _qualified(queries: DataFrame, placed: DataFrame, prefixes: DataFrame, rule: Rule) -> DataFrame:
    """The queries (node, grp) that can reach, with what the union of the group's counted tokens has, the overlap that a link
    needs; with root and n."""
    parts = prefixes.select(F.col("node").alias("_node"), "part", "n")
    asked = queries.select(F.col("grp").alias("_grp")).distinct()
    members = placed.join(asked, F.col("grp") == F.col("_grp"), "left_semi")
    union = members.join(parts, F.col("node") == F.col("_node")).select(F.col("grp").alias("u_grp"), F.explode("part").alias("u_token")).distinct()
    held = queries.join(parts, F.col("node") == F.col("_node")).select("node", "grp", F.explode("part").alias("token"))
    found = held.join(union, (F.col("grp") == F.col("u_grp")) & (F.col("token") == F.col("u_token"))).groupBy(F.col("node").alias("f_node"), F.col("grp").alias("f_grp")).agg(F.count("*").alias("common"))
    counted = queries.join(found, (F.col("node") == F.col("f_node")) & (F.col("grp") == F.col("f_grp")), "left")
    roots = placed.select(F.col("node").alias("r_node"), "root")
    whole = counted.join(prefixes.select(F.col("node").alias("_node"), "n", F.size("part").alias("counted")), F.col("node") == F.col("_node")).join(roots, F.col("node") == F.col("r_node"))
    lacking = F.col("counted") - F.coalesce("common", F.lit(0))
    return staged(whole.where(lacking <= F.col("n") - _needed(F.col("n"), rule)).select("node", "grp", "root", "n"), "qualified")


def classes_and_links(docs: DataFrame, rule: Rule) -> tuple[_Join, DataFrame]:
    """The classes, and links (a, b) between classes that connect all that are connected."""
    join = _Join(docs, rule)
    prefixes = join.postings()
    posted = prefixes.select("node", rule.size_class(F.col("n")).alias("own"), F.explode("tokens").alias("token"))
    # a class is at home in its own size class and looks into the next one
    looks = posted.select("node", "token", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("size"), "own").withColumn("home", F.col("own") == F.col("size")).drop("own")
    seeds = looks.groupBy("token", "size").agg(F.min(F.when(F.col("home"), F.col("node"))).alias("seed"), F.count("*").alias("held")).where("held > 1 and seed is not null")
    seeds = seeds.select(F.col("token").alias("_token"), F.col("size").alias("_size"), "seed")
    near = staged(looks.join(seeds, (F.col("token") == F.col("_token")) & (F.col("size") == F.col("_size"))).select("node", "token", "size", "home", "seed"), "near")
    # the group of a class: that of the least class of its size with which it shares a prefix token, the group's seed
    groups = near.groupBy("node").agg(F.coalesce(F.min(F.when(F.col("home"), F.col("seed"))), F.col("node")).alias("grp"))
    # every query with the seeds of its tokens
    star = join.linked(staged(near.where("node <> seed").select(F.col("node").alias("a"), F.col("seed").alias("b")).distinct(), "pairs"), prefixes)
    roots = components(star)
    placed = staged(groups.join(roots.select(F.col("node").alias("_node"), "root"), F.col("node") == F.col("_node"), "left").select("node", "grp", F.coalesce("root", "node").alias("root")), "placed")
    # where all classes that hold a token are of one component, it leads nowhere
    tokens = near.select("node", "token", "size", "home").join(placed.select(F.col("node").alias("_node"), "grp", "root"), F.col("node") == F.col("_node")).drop("_node")
    several = tokens.groupBy("token", "size").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select(F.col("token").alias("_token"), F.col("size").alias("_size"))
    open_ = staged(tokens.join(several, (F.col("token") == F.col("_token")) & (F.col("size") == F.col("_size")), "left_semi"), "open")
    matrix = open_.where("home").select(F.col("token").alias("m_token"), F.col("size").alias("m_size"), F.col("grp").alias("m_grp")).distinct()
    # groups of a size are ordered, and of two it is the lower one's classes that ask; those of the size below ask all
    met = open_.join(matrix, (F.col("token") == F.col("m_token")) & (F.col("size") == F.col("m_size"))).where((F.col("grp") <= F.col("m_grp")) | ~F.col("home"))
    queries = staged(met.select("node", F.col("m_grp").alias("grp")).distinct(), "queries")
    forget(near, open_)
    links = star
    if not queries.isEmpty():
        asking = _qualified(queries, placed, prefixes, rule)
        sizes = prefixes.select(F.col("node").alias("_node"), "n")
        asked = asking.select(F.col("grp").alias("_grp")).distinct()
        members = staged(placed.join(asked, F.col("grp") == F.col("_grp"), "left_semi").join(sizes, F.col("node") == F.col("_node")).select("node", "grp", "root", "n"), "members")
        sets = join.whole_sets(prefixes, asking.select("node").unionByName(members.select("node")))
        links = star.unionByName(_opened(asking, members, sets, rule))
        forget(sets)
    return join, links


def near_duplicates(df: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of df (doc_id, text; other columns don't matter).

    component_id is the least doc_id that is connected by links between rows of like sets, and by equal sets. A null
    or empty text, or one of white space only, has no shingle and is linked with nothing: its component is its
    own doc_id. Rows that repeat are copies. A null doc_id counts only where there is no other.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    join, links = classes_and_links(docs, rule)
    roots = components(links)
    lows = join.classes.select("node", "low", *_KEY)
    rooted = roots.join(lows.select(F.col("node").alias("_node"), "low"), F.col("node") == F.col("_node")).select("node", "root", "low")
    best = rooted.groupBy("root").agg(F.min("low").alias("component")).select(F.col("root").alias("_root"), "component")
    of_node = staged(rooted.join(best, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "component"), "components")
    named = lows.join(of_node, F.col("node") == F.col("_node"), "left").select(*[F.col(k).alias(f"_{k}") for k in _KEY], F.coalesce("component", "low").alias("component_id"))
    same = F.lit(True)
    for k in _KEY:
        same = same & (F.col(k) == F.col(f"_{k}"))
    full = join.members.where("n > 0").join(named, same).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(join.members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


#: The rule of the query.
QUERY = Rule(words=3, num=90, den=100)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents under links of 90 % of their three-word shingles."""
    return near_duplicates(documents(spark, sf_dir), QUERY)
