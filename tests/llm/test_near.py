"""The near stage tries every candidate pair, whatever its family or fingerprint."""

import random
from collections import Counter

import numpy as np

from sparkassay.llm import simhash


def _texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(7)) for _ in range(n)]


def _changed(text: list[str], rng: random.Random, n: int) -> list[str]:
    out = list(text)
    for at in rng.sample(range(len(out)), n):
        out[at] = "".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(7))
    return out


def _components(texts: list[str]) -> tuple[list[int], int]:
    """By brute force: the least member of each one's component, and the number of links."""
    sets = [simhash.shingle_set(t, 5) for t in texts]
    root, found = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                found += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root, found


def _grouped(spark, texts):
    got = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r["component_id"] for r in sorted(got, key=lambda r: r["doc_id"])]


def test_pairs_of_a_family_are_all_tried(spark):
    rng, texts, base = random.Random(5), [], _texts(0, 400)
    for _ in range(60):
        core = _changed(base, rng, 7)
        texts += [" ".join(core), " ".join(_changed(core, rng, 8))]
    want, _ = _components(texts)
    got = _grouped(spark, texts)
    pairs = [(i, i + 1) for i in range(0, len(texts), 2)]
    assert all(want[i] == want[j] for i, j in pairs)
    assert all(want[i] == want[g] for i, g in enumerate(got))  # nothing is linked that is not alike
    assert sum(got[i] == got[j] for i, j in pairs) >= 57  # of 60; keys are by chance beyond four bits


def _brute(entries):
    fp = np.array([e[0] for e in entries], np.int64)
    row, key = simhash.segment_keys(fp)
    keys = [set(key[row == i].tolist()) for i in range(len(fp))]
    apart = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    return sorted(
        (i, j) for j in range(len(fp)) for i in range(j)
        if keys[i] & keys[j] and entries[i][2] != entries[j][2] and apart(entries[i][0], entries[j][0]) <= simhash.NEAR
        and apart(entries[i][0], entries[j][0]) + apart(entries[i][1], entries[j][1]) <= simhash.BOTH
    )


def _entries():
    rng, out = random.Random(9), []
    for n in (2, 3, 10, 17, 60):
        fp, other = rng.getrandbits(63), rng.getrandbits(63)
        for _ in range(n):
            flip = lambda v, most: v ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, most)))
            out.append((flip(fp, 5), flip(other, 12), rng.randrange(40)))
    return out + [(5, 5, 100 + i) for i in range(30)]  # many rows of one fingerprint


def test_candidates_are_all_pairs(spark, monkeypatch):
    entries = _entries()
    df = spark.createDataFrame([(*e, i) for i, e in enumerate(entries)], "fp long, other long, comp long, row long")
    want = _brute(entries)
    assert len(want) > 800
    monkeypatch.setattr(simhash, "DENSE", 10_000)
    for run in (simhash.RUN, 8):
        monkeypatch.setattr(simhash, "RUN", run)
        pairs, dense = simhash.candidate_pairs(df)
        assert sorted((r["a"], r["b"]) for r in pairs.collect()) == want and dense.isEmpty()
    # Of dense runs the members come: every pair that is not listed is in one of them.
    monkeypatch.setattr(simhash, "DENSE", 1)
    for run in (4096, 8):
        monkeypatch.setattr(simhash, "RUN", run)
        pairs, dense = simhash.candidate_pairs(df)
        listed, members = {(r["a"], r["b"]) for r in pairs.collect()}, {}
        for r in dense.collect():
            members.setdefault(r["key"], set()).add(r["row"])
        assert listed < set(want) and all(p in listed or any(set(p) <= m for m in members.values()) for p in want)


def _family(n: int) -> list[str]:
    """Near copies of one text, each with changes of its own, so that many pairs are just alike and many just not."""
    rng, base = random.Random(6), _texts(77, 150)
    return [" ".join(_changed(base, rng, rng.randint(1, 7))) for _ in range(n)]


def test_dense_families_are_compared_as_a_whole(spark, monkeypatch):
    texts = _family(160) + ["", "  "] + [" ".join(_texts(500 + i, 60)) for i in range(20)]
    want, found = _components(texts)
    assert found > 500
    monkeypatch.setattr(simhash, "DENSE", 10_000)
    listed = _grouped(spark, texts)
    monkeypatch.setattr(simhash, "DENSE", 0)
    monkeypatch.setattr(simhash, "HELD", 20_000)  # several blocks
    whole = _grouped(spark, texts)
    joins = lambda fine, coarse: len(set(zip(fine, coarse, strict=True))) == len(set(fine))
    assert joins(listed, whole) and joins(whole, want)  # no link less than by pairs, and none that is not there
    assert len(set(whole)) <= len(set(want)) + 3


def test_links_within_join_what_all_pairs_join():
    rng = random.Random(12)
    for _ in range(30):
        sets = [np.unique(np.array([rng.randrange(40) for _ in range(rng.choice([0, 6, 12, 30]))], np.uint64)) for _ in range(25)]
        comps = [rng.randrange(60) for _ in sets]

        def closed(links):
            root = list(range(25))
            for a, b in [*links, *((i, j) for j in range(25) for i in range(j) if comps[i] == comps[j])]:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
            return root

        every = []
        for j in range(25):
            for i in range(j):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    every.append((i, j))
        assert closed(simhash.linked_within(sets, comps, 0.8)) == closed(every)


def test_recall_against_an_exact_join(spark, capsys):
    """Pairs just above the similarity, where keys are met by chance: the share that ends in one group."""
    rng, texts = random.Random(15), []
    for n in range(200):
        own = _texts(1000 + n, rng.choice([60, 150, 400]))
        texts += [" ".join(own), " ".join(_changed(own, rng, max(1, round(len(own) * 0.02))))]
    want, _ = _components(texts)
    got = _grouped(spark, texts)
    pairs = [(i, i + 1) for i in range(0, len(texts), 2) if want[i] == want[i + 1]]
    share = sum(got[i] == got[j] for i, j in pairs) / len(pairs)
    with capsys.disabled():
        print(f"near stage: {share:.3f} of {len(pairs)} true pairs found")
    assert len(pairs) > 100 and share >= 0.95


def test_repeated_words_do_not_hide_texts(spark):
    rng, texts = random.Random(4), []
    for n in range(30):
        own = _texts(100 + n, 150)
        texts += [" ".join(["word"] * 200 + own), " ".join(["word"] * 200 + _changed(own, rng, 1))]
    want, found = _components(texts)
    assert found == 30 and _grouped(spark, texts) == want


def _keyed(fps: list[tuple[int, int, int]], table: int) -> np.ndarray:
    """Entries of all fingerprints under all keys of a table, sorted by key."""
    turned = np.array([[f[(table + n) % 3] for n in range(3)] for f in fps], np.uint64).view(np.int64)
    row, key = simhash.segment_keys(np.ascontiguousarray(turned[:, 0]))
    x = np.stack([key, turned[row, 0], turned[row, 1], row, row], axis=1)
    return x[np.argsort(x[:, 0], kind="stable")]


def _family_of_prints(n: int, most: int = 6) -> list[tuple[int, int, int]]:
    rng = random.Random(21)
    base = [rng.getrandbits(64) for _ in range(3)]
    return [tuple(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, most))) for b in base) for _ in range(n)]


def test_a_run_gives_no_more_rows_than_it_has_entries():
    x = _keyed(_family_of_prints(300), 0)
    rows, entries = Counter(), Counter(x[:, 0].tolist())
    for key in entries:
        run = x[x[:, 0] == key]
        rows[key] = sum(len(a) + len(dense) for a, _, dense in simhash._all_pairs(run, run[:, 0], many=simhash.DENSE))
    assert sum(rows.values()) > 1000 and all(rows[k] <= entries[k] for k in entries)


def test_dense_runs_pass_each_row_once(spark, monkeypatch):
    """Not once under each of its keys; and what one table's clusters settle is not passed on again by the others."""
    texts = _family(160)
    want, _ = _components(texts)
    given, cut = [], simhash.cluster_links
    monkeypatch.setattr(simhash, "DENSE", 0)
    monkeypatch.setattr(simhash, "NEAR", 20)  # candidates enough that one cluster has all
    monkeypatch.setattr(simhash, "BOTH", 44)
    monkeypatch.setattr(simhash, "cluster_links", lambda members, *rest: (given.append(sorted(r["row"] for r in members.collect())), cut(members, *rest))[1])
    got = _grouped(spark, texts)
    assert given and all(len(rows) == len(set(rows)) for rows in given) and len(given[0]) > 100
    assert sum(map(len, given)) < 2 * len(texts)
    assert all(want[i] == want[g] for i, g in enumerate(got))


def test_dense_runs_join_only_what_candidates_connect():
    """Two families that share a key are two parts of its run."""
    one, other = 0b1011 << 40, (0b1011 << 40) ^ ((1 << 18) - 1 << 46)
    x = np.array([(7, base ^ (1 << k), 0, k + at, k + at) for base, at in ((one, 0), (other, 100)) for k in range(20)], np.uint64).view(np.int64)
    x[:, 0] = 7
    keep, simhash.smallest_shared_key = simhash.smallest_shared_key, lambda a, b: np.full(len(a), 7)
    try:
        dense = np.concatenate([d.reshape(-1, 2) for _, _, d in simhash._all_pairs(x, x[:, 0], many=1)])
    finally:
        simhash.smallest_shared_key = keep
    assert sorted(dense.tolist()) == [[i, 0 if i < 20 else 20] for i in range(40)]


def test_clusters_are_compared_whole_in_blocks(spark, monkeypatch):
    texts = _family(90)
    want, _ = _components(texts)
    monkeypatch.setattr(simhash, "FEWEST", 10)
    plain = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    members = spark.createDataFrame([(5, i, i) for i in range(90)], "cluster long, row long, comp long")
    links = simhash.cluster_links(members, plain, 5, 0.8).collect()
    root = list(range(90))
    for r in links:
        root = [min(root[r["a"]], root[r["b"]]) if x in (root[r["a"]], root[r["b"]]) else x for x in root]
    assert root == want
