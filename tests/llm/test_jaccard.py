import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from lodestone.llm import jaccard as J
from lodestone.runtime import shared_folder

SCHEMA = "doc_id long, text string, sid string, label string, jaccard double"


def grams(text, n=3):
    w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold, n=3):
    """Pairs of class representatives, and (representative, member, 1) of every other member."""
    classes = {}
    for i, t in rows:
        if i is not None and t and grams(t, n):
            classes.setdefault(frozenset(grams(t, n)), set()).add(i)
    out = {(min(ids), i): 1.0 for ids in classes.values() for i in ids if i != min(ids)}
    reps = [(min(ids), x) for x, ids in classes.items()]
    for k, (a, x) in enumerate(reps):
        for b, y in reps[k + 1 :]:
            if a != b and len(x & y) / len(x | y) >= threshold - 1e-12:
                out[min(a, b), max(a, b)] = max(out.get((min(a, b), max(a, b)), 0), round(len(x & y) / len(x | y), 6))
    return out


def texts(seed, many=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [[r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 12, 40, 90, 300]))] for _ in range(many)]
    out = [" ".join(b) for b in base]
    for b in base[: many // 2]:
        for _ in range(r.randint(1, 4)):
            c = [r.choice(words) if r.random() < r.choice([0, 0.02, 0.05, 0.15]) else w for w in b]
            out.append(" ".join(c))
    return list(enumerate(out))


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "s", "l", 0.0) for i, t in rows], SCHEMA)
    return {(r.doc_id_a, r.doc_id_b): r.jaccard for r in J.similar_pairs(df, **options).collect()}


@pytest.mark.parametrize("seed,threshold,unit,sets", [(0, 0.55, 2_000_000, 1500), (1, 0.8, 40, 1500), (2, 0.3, 300, 5), (3, 0.15, 2_000_000, 3)])
def test_all_pairs_against_brute_force(spark, seed, threshold, unit, sets):
    rows = texts(seed)
    assert found(spark, rows, threshold=threshold, unit_tokens=unit, unit_sets=sets, group_tokens=2) == brute(rows, threshold)


def test_sizes_far_apart(spark):
    words = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(words[:5])), (2, " ".join(words[:18]))]  # 3 of 16 n-grams
    assert found(spark, rows, threshold=0.15) == {(1, 2): 0.1875} == brute(rows, 0.15)


def test_near_copies_are_the_groups_of_pairs(spark):
    rows = texts(5)
    group = {i: i for i, _ in rows}
    for a, b in brute(rows, 0.55):
        x, y = group[a], group[b]
        group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    df = spark.createDataFrame([(i, t, "s", "l", 0.0) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.keeper for r in J.near_copies(df, group_tokens=2).collect()}
    assert got == {i: g for i, g in group.items() if g != i} and got


def test_classes_and_links(spark):
    rows = [*texts(6), (900, None), (901, ""), (None, "a b c"), (0, texts(6)[0][1])]
    pairs, group = brute(rows, 0.55), {i: i for i, _ in rows if i is not None}
    own = {i: frozenset(grams(t)) for i, t in rows if i is not None and t}
    for a, b in pairs:
        x, y = group[a], group[b]
        group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    reps = [p for p in pairs if own[p[0]] != own[p[1]]]
    links = {i: sum(own[i] in (own[a], own[b]) for a, b in reps) if i in own else 0 for i in group}
    df = spark.createDataFrame([(i, t, "s", "l", 0.0) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.class_id, r.links) for r in J.near_classes(df, group_tokens=2).collect()}
    assert got == {i: (group[i], links[i]) for i in group} and max(links.values()) > 1
    assert J.near_classes(df.limit(0)).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", 1, 1, 1), (2, "a b c", 1, 1, 1), (3, "d e", 1, 1, 1)], "doc_id long, text string, _gone int, _GONE1 int, keeper int")
    kept = J.deduplicate(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("seed", range(8))
def test_local_join_misses_no_pair(seed):
    r = np.random.default_rng(seed)
    core = r.integers(0, 2**32, 40, dtype=np.uint64)
    sets = []
    for _ in range(30):
        keep = core[r.random(40) < r.choice([0.5, 0.9, 1.0])]
        sets.append(np.unique(np.concatenate([keep, r.integers(0, 2**32, r.integers(0, 12), dtype=np.uint64)]).astype(np.uint32)))
    sets = [s for s in {s.tobytes(): s for s in sets}.values() if len(s)]
    size = np.array([len(s) for s in sets])
    root = J.local_pairs(size, size, np.concatenate(sets), 1, 0.6)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.6:
                assert root[i] == root[j]


def test_edges_and_dedupe(spark):
    rows = [(1, "a b c d e"), (2, "A b, c d e"), (2, "A b, c d e"), (None, "a b c d e"), (3, None), (4, ""), (5, "..."), (6, "x"), (7, "x"), (8, "y " * 30_000), (9, "z q r"), (9, "a b c d e")]
    assert found(spark, rows) == brute(rows, 0.55)
    df = spark.createDataFrame([(i, t, "s", "l", 0.0) for i, t in rows], SCHEMA)
    kept = J.deduplicate(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8]
    assert found(spark, []) == {} and J.deduplicate(df.limit(0)).count() == 0


def test_no_group_task_grows_with_the_corpus(spark):
    bound, most = 1500, []
    for many in (60, 240):
        df = spark.createDataFrame(texts(7, many), "doc_id long, text string")
        placed = J._placed(df, 3, 0.55, 20_000, bound)[1]
        parts = J._parts(placed, 3, 0.55, 64).selectExpr("bin", "low", "high", "key", "length(tokens) / 4 as tokens")
        held = parts.groupBy("bin", "low", "high", "key").sum("tokens").toPandas()["sum(tokens)"]
        most.append(held.max())
        assert held.max() <= 2 * bound
    assert held.sum() > 6 * bound and most[1] < 2 * most[0]


def test_component_beyond_a_bin_loses_no_pair(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(80)]
    rows = [(i, " ".join(w if r.random() > 0.08 else f"w{r.randrange(500)}" for w in base)) for i in range(60)]
    assert found(spark, rows, group_tokens=8, cell_chars=1_000, bin_tokens=300) == brute(rows, 0.55)


def test_blocks_of_a_large_component_go_in_pieces():
    r = random.Random(1)
    text = [" ".join(f"w{r.randrange(10**6)}" for _ in range(2_000)) for _ in range(10)]
    sid = J.set_ids(*J.token_sets(text, 3)).view(np.int64)
    rows = pd.DataFrame({"sid": sid, "bin": 5, "blocks": 1_000, "block": 7, "text": text})
    held, pairs = [], 0
    for piece in J._spread(3, 0.55, 64)(iter([rows])):
        held.append(sum(piece[c].str.len().sum() for c in ("sid", "size", "part", "tokens")))
        pairs += piece.groupby("key")[["low", "high"]].value_counts().shape[0]
    assert sum(held) > 5 * J._PIECE and max(held) < 1.1 * J._PIECE
    assert pairs == sum(1_000 * J.groups_of(at, 64) for at in (10, 11))


def test_chance_n_grams_connect_no_bins(spark):
    rows = []
    for k in range(60):  # groups of 3 near copies; each shares a passage with the group before and the one behind
        words = [f"g{k}w{i}" for i in range(60)]
        for copy in range(3):
            own = [w if i not in (20 + copy, 40 + copy) else f"g{k}c{copy}w{i}" for i, w in enumerate(words)]
            links = [f"link{k + (copy == 1)}x{i}" for i in range(6)] if copy < 2 else []
            rows.append((len(rows), " ".join(own + links)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = J._placed(df, 3, 0.55, 20_000, 1_000)[1].toPandas()
    assert placed["size"].sum() > 8_000 and placed["blocks"].max() == 1
    assert found(spark, rows, cell_chars=20_000, bin_tokens=1_000) == brute(rows, 0.55) and len(brute(rows, 0.55)) == 180


def test_what_a_cell_holds_is_its_own(spark):
    df = spark.createDataFrame(texts(8, 200), "doc_id long, text string").repartition(30)
    blobs = df.mapInPandas(J._cells(3, 12), "cell int, chunk long, sets int, many binary, tokens binary, sid binary, size binary, ids binary").toPandas()
    assert len(blobs) == 30 * 13 and blobs.loc[blobs["cell"] >= 0, ["sid", "size", "ids"]].isna().all(axis=None)
    own = blobs[blobs["cell"] < 0]
    assert own["chunk"].nunique() == 30 and own["cell"].nunique() > 6 and own["ids"].str.len().sum() == 8 * df.count()


def test_a_chunk_is_hashed_in_pieces():
    r = random.Random(9)
    text = [" ".join(f"w{r.randrange(10**5)}" for _ in range(r.choice([0, 1, 2, 40, 1_500]))) for _ in range(2_000)]
    text[7:7] = [None, "", "..."]
    text[900] = " ".join(f"w{r.randrange(10**5)}" for _ in range(60_000))  # longer than a piece
    assert sum(len(t or "") for t in text) > 4_000_000
    alone = [J.token_sets([t], 3) for t in text]
    tracemalloc.start()
    tokens, many = J.token_sets(text, 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100_000_000
    assert (tokens == np.concatenate([t for t, _ in alone])).all() and (many == np.concatenate([m for _, m in alone])).all()
    assert [x.shape for x in J.token_sets([], 3)] == [(0,), (0,)]


def test_few_files_are_written(spark):
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.rglob("*.parquet"))
    df = spark.createDataFrame([(i, " ".join(f"c{i // 5}w{k}" for k in range(100 + i % 5))) for i in range(300)], "doc_id long, text string").repartition(20)
    assert {r.links for r in J.near_classes(df).collect()} == {4}
    wrote = [p.parent.name.split("-")[1] for p in set(folder.rglob("*.parquet")) - before if p.is_file()]
    assert len(wrote) < 16, sorted(wrote)  # each starts processes where modes can't be set otherwise


def test_components_of_few_and_of_many_edges(spark, monkeypatch):
    r = random.Random(4)
    edges = [(a, a + r.randint(0, 3)) for a in r.sample(range(-300, 300), 250)] + [(-(2**62), 2**62), (7, 7)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(8)
    for most in (1_000_000, 10):
        monkeypatch.setattr(J, "_EDGES", most)
        assert {x.node: x.label for x in J._labels(df).collect()} == root
    assert J._labels(df.limit(0)).count() == 0 == J._labels(df.where("a = b")).count()


@pytest.mark.parametrize("seed", range(4))
def test_parities_rule_out_no_near_pair(seed):
    r = np.random.default_rng(seed)
    sets = [np.unique(r.integers(0, 400, r.integers(1, 300))) for _ in range(60)]
    shared = np.array([len(s) for s in sets])
    low = np.concatenate(sets).astype(np.uint32)
    blob = J.sketches(np.repeat(np.arange(60), shared), np.zeros(len(low), np.int64), low, shared)
    ends = np.cumsum(J._widths(shared))
    parts = [blob[e - w : e] for e, w in zip(ends, J._widths(shared))]
    i, j = np.triu_indices(60, 1)
    rows = pd.DataFrame({"a": i, "b": j})
    for x, at in (("a", i), ("b", j)):
        rows = rows.assign(**{f"size_{x}": shared[at], f"shared_{x}": shared[at], f"sketch_{x}": [parts[k] for k in at]})
    kept = {(a, b) for a, b in next(J._close(0.3)(iter([rows]))).to_numpy().tolist()}
    near = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if len(np.intersect1d(sets[a], sets[b])) >= 0.3 * len(np.union1d(sets[a], sets[b]))}
    assert near <= kept and near and len(kept) < len(i)
