"""The routing and the solvers of the substring operators, against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from fathom.llm import common, line_dedup, linking, repeats, substring_rlz, substring_suffix
from fathom.llm.common import mix64
from fathom.llm.suffix_sort import sorted_suffixes


@pytest.fixture(scope="module")
def corpus():
    """Texts with planted passages amid other words, copies, a periodic text and texts that end in a passage."""
    pick = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{x}" for x in pick.integers(0, 4000, n))
    shared = [word(60), word(45), word(30)]
    texts = [word(int(n)) for n in pick.integers(5, 90, 60)]
    for k in range(0, 60, 2):
        texts[k] = f"{texts[k]} {shared[k % 3]} {word(int(pick.integers(0, 9)))}".strip()
    texts += [texts[4], texts[4], texts[7], "ab cd " * 200, shared[0], f"{shared[0]} {shared[1]} {shared[0]}"]
    return list(enumerate(texts))


@pytest.mark.parametrize("window", [250, 120])
@pytest.mark.parametrize("hot", [2000, 2])
def test_removed_bytes(spark, corpus, hot, window, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    count = Counter(raw[j : j + window] for raw in (t.encode() for _, t in corpus) for j in range(len(raw) - window + 1))
    want = {}
    for i, t in corpus:
        raw, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for j in range(len(raw) - window + 1):
            if count[raw[j : j + window]] > 1:
                gone[j : j + window] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want[i] = int(gone.sum()), int((edge > 0).sum()), kept
    rows = substring_suffix.remove_repeats(spark.createDataFrame(corpus, "doc_id long, text string").repartition(3), window=window, gram=24, chunk=40).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows} == want


@pytest.mark.parametrize("hot", [2000, 2])
def test_factors(spark, corpus, hot, monkeypatch):
    """Every factor equals its earlier reference, and the factors cover exactly the windows that start earlier."""
    monkeypatch.setattr(repeats, "HOT", hot)
    words = {i: t.split() for i, t in corpus}
    seen, want = set(), defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - 19):
            if tuple(w[j : j + 20]) in seen:
                want[i] |= set(range(j, j + 20))
            seen.add(tuple(w[j : j + 20]))
    got = defaultdict(set)
    for f in substring_rlz.factors(spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)).collect():
        own, ref = words[f["doc"]], words[f["ref_doc"]]
        n = min(f["n"], len(own))
        if f["n"] == repeats.WHOLE and n < 20:
            continue
        assert n >= 20 and own[f["start"] : f["start"] + n] == ref[f["ref_start"] : f["ref_start"] + n]
        assert (f["ref_doc"], f["ref_start"]) < (f["doc"], f["start"])
        got[f["doc"]] |= set(range(f["start"], f["start"] + n))
    assert dict(got) == dict(want)


def test_chunks_stay_where_they_are(spark, corpus, monkeypatch):
    """Neither copies nor hot cores make the table of open chunks go through a shuffle before it is grouped by document."""
    monkeypatch.setattr(repeats, "HOT", 2)
    plans, solved = [], repeats.solved
    monkeypatch.setattr(repeats, "solved", lambda docs, chunks, *more: (plans.append(chunks._jdf.queryExecution().executedPlan().toString()), solved(docs, chunks, *more))[1])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert substring_rlz.factors(spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(plans) == 2 and not any("hashpartitioning" in plan for plan in plans)


def test_greedy_parse_takes_the_longest():
    word = lambda *x: np.array(x, np.uint64).tobytes()
    block = substring_rlz.Block(4)
    block.add(word(*range(6), 90), 3, 5)
    block.add(word(*range(8), 91), 4, 5)
    piece = word(*range(12))
    assert substring_rlz.parse(piece, 9, 5, block) == [(0, 8, (1, 0))]
    # the first window over the factor's end is asked again, and 5 .. 10 is a factor of its own once it is indexed
    block.add(word(*range(5, 11), 92), 3, 0)
    assert substring_rlz.parse(piece, 9, 5, block) == [(0, 8, (1, 0)), (5, 6, (2, 0))]


def test_common_prefixes_of_sorted_suffixes():
    pick = np.random.default_rng(1)
    text = pick.integers(0, 2, 400).astype(np.uint8)
    text[100:300] = text[:200]
    start = np.arange(150)
    order, common = sorted_suffixes(text, start, np.zeros(150, np.int64), 200)
    raw = text.tobytes()
    cuts = [raw[s : s + 200] for s in start[order]]
    assert cuts == sorted(cuts)
    for k in range(1, 150):
        size = next((i for i, (a, b) in enumerate(zip(cuts[k - 1], cuts[k], strict=True)) if a != b), 200)
        assert common[k] == size or size <= 64 and common[k] <= size


def sent_rows(n: int) -> int:
    """Rows that one task sends for n entries."""
    entry = np.zeros(n, repeats.ENTRY)
    entry["core"] = mix64(np.arange(n, dtype=np.uint64))
    parts = np.array_split(entry, max(1, n // 5000))
    return sum(len(b) for b in repeats.send_all(iter(parts), linking.bucket_bits(n, repeats.PER_BUCKET)))


def test_packed_rows_grow_with_the_entries():
    small, large = sent_rows(1_200_000), sent_rows(6_000_000)
    assert large <= 7 * small and large < 3000


def test_thinned_marks_what_it_holds_back():
    entry = np.zeros(1000, repeats.ENTRY)
    entry["core"], entry["context"], entry["doc"] = 7, np.arange(1000), np.arange(1000)
    go, direct = repeats.thinned(entry)
    assert len(go) == repeats.SEEN and len(go) + len(direct) == 1000
    assert go["many"].all() and (go["stands"].astype(int) + 1).sum() == 1000


def test_window_hashes_are_span_hashes():
    """op9 hashes the shingles of all places in blocks; the blocks' edges and short texts must not show."""
    for n in (0, 3, common.CACHED + 5, 2 * common.CACHED + 8):
        prefix = common.prefix_sums(np.arange(n, dtype=np.uint64) % np.uint64(97), common.WORD_BASE)
        at = np.arange(max(0, n - 7))
        assert np.array_equal(common.window_hashes(prefix, common.WORD_BASE, 8)[: len(at)], common.span_hashes(prefix, common.WORD_BASE, at, at + 8))


def test_pairs_of_sets():
    """Each pair is compared on its own, and equal sets too."""
    sets = line_dedup.line_sets([b"abcdefghabcdefgh", b"abcdefgh", b"short", b"abcdefghi"])
    one, two = np.array([0, 0, 1, 2, 2]), np.array([1, 0, 3, 2, 0])
    assert [len(s) for s in sets] == [8, 1, 1, 2]
    assert linking.pair_overlaps(sets, one, two).tolist() == [1, 8, 1, 1, 0]


def test_components_by_rounds_and_by_one_task(spark, monkeypatch):
    """The union-find's rounds, one task alone, and rounds that one task finishes give the same components."""
    pick = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in pick.integers(0, 600, (330, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for few in (0, 20, linking.FEW):
        monkeypatch.setattr(linking, "FEW", few)
        assert {r["node"]: r["component"] for r in linking.connected(table, "test").collect()} == {x: root(x) for x in parent}


def test_tasks_of_small_tables(spark):
    """A filter and components of a few rows don't start a Python task for every shuffle partition, and no rounds."""
    from pyspark.sql import functions as F

    pairs = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    settings = {"spark.sql.shuffle.partitions": "400", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    context = spark.sparkContext

    def tasks(name, run):
        context.setJobGroup(name, name)
        run()
        context.setLocalProperty("spark.jobGroup.id", None)
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
        return sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))

    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert tasks("small-filter", lambda: linking.needed(pairs.select(F.col("a").alias("node")))) < 600
        assert tasks("small-components", lambda: linking.connected(pairs, "test").collect()) < 100
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
