"""Conversation trie: parentheses, shards and spines against a dictionary of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import conversation_trie as C
from panelspark.llm import queries as Q
from panelspark.llm.parens import Parens, subtree_mins, subtree_sums
from tests.llm.oracle import same_rows


def random_bits(rng, n, drift):
    bits, depth = [1], 1
    while len(bits) < n:
        up = depth == 1 or rng.random() < drift
        bits.append(int(up))
        depth += 1 if up else -1
    return np.array(bits + [0] * depth)


@pytest.mark.parametrize(("n", "drift"), [(1, 0.5), (60, 0.5), (130, 0.9), (5000, 0.5), (5000, 0.99), (20_000, 0.45)])
def test_parentheses_match_a_stack(n, drift):
    rng = np.random.default_rng(n)
    bits = random_bits(rng, n, drift)
    stack, close, parent, number = [], {}, {}, -1
    for p, bit in enumerate(bits.tolist()):
        if bit:
            number += 1
            parent[number] = stack[-1][1] if stack else -1
            stack.append((p, number))
        else:
            close[stack.pop()[1]] = p
    tree, nodes = Parens(bits), number + 1
    assert tree.closes.tolist() == [close[v] for v in range(nodes)]
    assert tree.parents().tolist() == [parent[v] for v in range(nodes)]
    values = rng.integers(-50, 50, nodes)
    ends = tree.ends()
    leaf = [v + 1 == e for v, e in enumerate(ends)]
    some = range(0, nodes, max(nodes // 200, 1))
    assert [subtree_sums(values, ends)[v] for v in some] == [values[v:ends[v]].sum() for v in some]
    assert [subtree_mins(values, ends)[v] for v in some] == [values[v:ends[v]].min() for v in some]
    assert [tree.leaf_pairs()[v] for v in some] == [sum(leaf[v:ends[v]]) for v in some]


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            convs[c].append(((turn is not None, turn or 0, role, tie), (role, text)))
    return {c: [x for _, x in sorted(v)] for c, v in convs.items()}


def brute(convs):
    members, ended = defaultdict(list), defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ended[tuple(s)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) or 1
        saved[p] = sum(saved[q] for q in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ids = ",".join(map(str, sorted(ended[p])))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def splice(convs):
    out = {}
    for c, s in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + s[h:]
    return out


def got(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return sorted((tuple(r) for r in df.select(*cols, F.lower(F.hex("ends"))).collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def odd_turns():
    rows = [(0, 0, "user", "hi"), (0, 1, None, None), (0, 1, "", ""), (0, None, "user", "first"), (1, 0, "user", "hi"),
            (1, 0, "user", "hi"), (2, None, None, None), (3, 5, "bot", "é漢"), (3, 2, "user", ""), (None, 0, "user", "nobody"),
            (7, 0, "us", "erx"), (8, 0, "user", "x"), (9, 0, "user", None), (13, 0, "user", "lone"), (14, 0, "user", "lone")]
    rows += [(20, t, "user", f"t{t % 7}") for t in range(900)]
    rows += [(21, t, "user", f"t{t % 7}") for t in range(900)]
    rows += [(c, 0, "system", "same") for c in range(100, 400)]
    rows += [(c, t, "user", f"{c % t}") for c in range(200, 300) for t in range(1, 6)]
    return rows


@pytest.mark.parametrize(("turns", "paths"), [(500_000, 64), (40, 4), (200, 4)])
def test_shards_and_rounds_of_spines_give_the_trie(spark, turns, paths):
    rows = odd_turns()
    seqs = C.sequences(table(spark, rows))
    want = ordered(rows)
    assert got(C.nodes(seqs, turns, paths)) == brute(want)


def test_spliced_conversations(spark):
    rows = odd_turns()
    seqs = C.spliced(C.sequences(table(spark, rows)))
    want = splice(ordered(rows))
    assert {r["conv_id"]: len(r["turns"]) for r in seqs.collect()} == {c: len(s) for c, s in want.items()}
    assert any(not s for s in want.values())
    assert got(C.nodes(seqs, 60, 5)) == brute(want)


def test_ids_of_a_hot_node_are_hashed_in_order(spark):
    rows = [(c, 0, "user", "same") for c in range(5000)]
    assert got(C.nodes(C.sequences(table(spark, rows)), 300, 4)) == brute(ordered(rows))


def test_too_few_paths_a_shard_are_refused(spark):
    with pytest.raises(ValueError):
        C.nodes(C.sequences(table(spark, [])), shard_paths=3)


def test_empty_table_has_no_nodes(spark):
    assert C.nodes(C.spliced(C.sequences(table(spark, [])))).count() == 0


def test_extra_columns_and_odd_turns_in_the_query(spark, tmp_path):
    rows = odd_turns()
    docs = table(spark, rows).withColumn("path", F.lit(1)).withColumn("shard", F.lit("x"))
    docs.write.parquet(f"{tmp_path}/conversations.parquet")
    df = Q.op12_conversation_trie(spark, str(tmp_path)).withColumn("ends", F.unhex("ends_sha256"))
    assert got(df) == brute(splice(ordered(rows)))


def test_query_on_the_smallest_tables_is_its_sql(spark):
    same_rows(spark, "op12_conversation_trie", "/root/testdata/sf0.01")
