"""Reply trees against a recursive walk, and the format's exact inverse."""

import hashlib
import random

from glyphmill.llm import chat, queries

SCHEMA = "tree long, node long, parent long, role string, text string, score double, formatted string"


def walk(rows):
    by, children = {r[1]: r for r in rows}, {}
    for r in rows:
        children.setdefault(r[2], []).append(r[1])
    out = {}
    for node in by:
        if node not in children:
            path, at = [], node
            while at in by:
                path.append(at)
                at = by[at][2]
            out[node] = path[::-1]
    return out


def trees():
    r = random.Random(1)
    odd = ["", None, "<|end|>\n", "<\\|role|>x", "<\\\\|", "<|", "<", "é日<|end|>", "a\nb"]
    rows, node = [], 0
    for tree in range(12):
        mine = []
        for k in range(r.randint(1, 40)):
            parent = r.choice(mine[-3:]) if mine else None
            rows.append((tree, node, parent, r.choice(["user", "assistant", None, "a\nb<|newline|>"]), r.choice(odd), r.choice([None, r.random()]), "clash"))
            mine.append(node)
            node += 1
    return rows


def test_all_paths_and_format(spark):
    rows = trees()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    by, want = {r[1]: r for r in rows}, walk(rows)
    got = {r.leaf: r for r in chat.format_trees(df, best=None).collect()}
    assert set(got) == set(want)
    for leaf, path in want.items():
        r = got[leaf]
        assert r.n_turns == len(path) and r.tree == by[leaf][0]
        assert chat.parse(r.formatted) == [(by[n][3] or "", by[n][4] or "") for n in path]
        learned = "".join(chat.unescape(r.formatted[m.start : m.start + m.length]) for m in r.mask)
        assert learned == "".join(by[n][4] or "" for n in path if by[n][3] == "assistant")
    best = {r.tree: r.leaf for r in chat.format_trees(df, best=1).collect()}
    for tree in {r[0] for r in rows}:
        mean = {leaf: sum(by[n][5] or 0.0 for n in p) / len(p) for leaf, p in want.items() if by[leaf][0] == tree}
        assert abs(mean[best[tree]] - max(mean.values())) < 1e-12


def test_cycles_and_empty(spark):
    rows = [(1, 1, None, "user", "a", 0.0, ""), (1, 2, 1, "assistant", "b", 0.0, ""), (2, 5, 6, "user", "x", 0.0, ""), (2, 6, 5, "user", "y", 0.0, ""), (2, 7, 6, "user", "z", 0.0, ""), (3, 9, 99, "user", "root", 0.0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.leaf, r.n_turns) for r in chat.format_trees(df).collect()) == [(2, 2), (9, 1)]
    assert chat.format_trees(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.conv_id: r for r in queries.op9_chat_format(spark, sf).collect()}
    convs = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
