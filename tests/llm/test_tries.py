"""The conversation trie against prefixes spelled out."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from swaplens.llm import conversation_trie

from .helpers import table

TURNS = "conv_id long, turn long, role string, text string"
CONTRACT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows, group=5, most=9):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for node, ids in members.items():
        below = [v for v in members if v[: len(node)] == node]
        leaf = lambda v: not any(len(w) == len(v) + 1 and w[: len(v)] == v for w in members)
        ends = ",".join(str(c) for c in sorted(c for c in ids if rebuilt[c] == node))
        out.append((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), sum(len(v) == len(node) + 1 for v in below), sum(leaf(v) for v in below),
            sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def awkward_turns(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(40), -7, -5, 10**15, 10**15 + 3]:
        for turn in range(rng.randrange(1, 14)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é😀"])))
    rows += [(50, None, "user", "x"), (50, None, "user", "x"), (50, 3, None, None), (50, 3, "b", "a"), (51, 1, "user", "x")]
    rows += [(c, t, "user", f"long{t % 7}") for c in (60, 61, 62) for t in range(100)]  # the same but for their numbers
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("block", [3, 256])
def test_trie_is_that_of_all_prefixes(spark, monkeypatch, block):
    """Whatever the size of blocks: with 3, ranks take four levels and ends lists several pieces."""
    monkeypatch.setattr(conversation_trie, "TURNS", block)
    monkeypatch.setattr(conversation_trie, "ENDS", 8)
    rows = awkward_turns(1)
    df = spark.createDataFrame(rows, TURNS).repartition(5).selectExpr("*", "'clash' AS d", "1 AS h1", "2 AS rank", "3 AS n")
    got = conversation_trie.rebuilt_trie(df)
    found = got.collect()
    assert sorted((tuple(r[c] for c in CONTRACT) for r in found), key=repr) == sorted(plain_trie(rows), key=repr)
    # preorder: places are 0, 1, 2, ...; a subtree is an interval, and the parent's interval holds it
    assert sorted(r.preorder for r in found) == list(range(len(found)))
    root = next(r for r in found if r.depth == 0)
    assert (root.preorder, root.subtree_end) == (0, len(found))
    by_place = sorted(found, key=lambda r: r.preorder)
    for r in found:
        inside = by_place[r.preorder : r.subtree_end]
        assert all(x.depth > r.depth for x in inside[1:]) and sum(x.n_children == 0 for x in inside) == r.n_leaves
        assert r.subtree_end == len(found) or by_place[r.subtree_end].depth <= r.depth


def test_tries_without_rows_or_turns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversation_trie.rebuilt_trie(empty).count() == 0
    # 7 has one turn, which its missing base's head replaces: crc32("7") % 9 is at least 1
    assert zlib.crc32(b"7") % 9 >= 1
    only = conversation_trie.rebuilt_trie(spark.createDataFrame([(7, 0, "user", "x")], TURNS)).collect()
    assert [tuple(r[c] for c in CONTRACT) for r in only] == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]


def test_general_tries(spark):
    """Without rebuilding: any numbered turns, here with a conversation that holds most rows and one that has none."""
    rows = [(1, t, "user", str(t % 3)) for t in range(700)] + [(2, t, "user", str(t % 3)) for t in range(5)]
    turns = conversation_trie.numbered(spark.createDataFrame(rows, TURNS).repartition(4))
    assert turns.where("conv_id = 1").agg(F.min("d"), F.max("d"), F.count_distinct("d")).first()[:] == (1, 700, 700)
    ids = spark.createDataFrame([(1, 700), (2, 5), (3, 0)], "conv_id long, n long")
    trie = {r.depth: r for r in conversation_trie.prefix_trie(turns, ids).collect()}
    assert len(trie) == 701 and trie[0].n_convs == 3 and trie[5].n_convs == 2 and trie[6].n_convs == 1 and trie[700].n_leaves == 1
    assert trie[0].saved_tokens == 5 and trie[5].ends_sha256 == hashlib.sha256(b"2").hexdigest() and trie[0].ends_sha256 == hashlib.sha256(b"3").hexdigest()


def test_trie_of_the_given_table(spark, tiny):
    rows = [tuple(r) for r in table(spark, tiny, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = conversation_trie.rebuilt_trie(table(spark, tiny, "conversations")).select(CONTRACT).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_trie(rows), key=repr)
