import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from macropanel.llm import common, embedding_dedup, exact_dedup, line_dedup, ngram_join, substring_dedup
from macropanel.llm.common import land
from macropanel.llm.components import connected_components

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def plain(rows):
    return sorted(map(tuple, rows), key=str)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 400)] + [(1000, i) for i in range(1001, 1500)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(450)]
    rng.shuffle(links)
    want = components({x for p in links for x in p}, links)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in links)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- exact ----------------------------------------------------------------------------------------


def test_exact_duplicates(odd_docs, no_docs):
    groups = defaultdict(list)
    rows = odd_docs.collect()
    for r in rows:
        groups[re.sub(f"[{SPACE}]+", " ", r.text or "")].append(r.doc_id)
    got = exact_dedup.exact_duplicates(odd_docs).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(groups)
    assert {re.sub(f"[{SPACE}]+", " ", r.text or "") for r in kept.collect()} == set(groups)
    assert exact_dedup.exact_duplicates(no_docs).count() == 0 and exact_dedup.drop_exact_duplicates(no_docs).count() == 0


def test_members_of_the_history_are_repeats(spark, docs_of):
    old = exact_dedup.digests(docs_of([(1, "a"), (2, "b"), (5, "b"), (9, "c")]))
    new = exact_dedup.digests(docs_of([(3, "b"), (0, "c"), (7, "d"), (8, "d"), (11, "e")]))
    index = exact_dedup.build_index(old, 3)
    got = {(r.keep_id, r.group_size, r.member) for r in exact_dedup.look_up(index, new, 3).collect()}
    assert got == {(1, 1, None), (2, 3, True), (0, 2, True), (7, 2, False), (11, 1, False)}


# --- lines ----------------------------------------------------------------------------------------


def lines_by_hand(rows, min_docs):
    count = defaultdict(set)
    for n, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            count[lower(line.strip(SPACE))].add(n)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (k := lower(x.strip(SPACE))) or len(count[k]) < min_docs]
        out.append((doc, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return plain(out)


def test_lines(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for least in (2, 3):
        state = line_dedup.insert(odd_docs, 4, min_docs=least)
        assert plain(line_dedup.drop_repeated_lines(odd_docs, state, 4).collect()) == lines_by_hand(rows, least)
    assert line_dedup.drop_repeated_lines(no_docs, line_dedup.insert(no_docs, 4), 4).count() == 0


def test_deleting_documents_gives_the_former_state_back(docs_of):
    rng = random.Random(4)
    say = lambda: "\n".join(rng.choice([f"line {k}", f"  LINE {k}\t"]) for k in rng.choices(range(60), k=8))
    first, second = [(i, say()) for i in range(80)], [(i + 100, say()) for i in range(60)]
    a, b = docs_of(first), docs_of(second)
    one = line_dedup.insert(a, 5)
    both = line_dedup.insert(b, 5, one)
    again = line_dedup.delete(b, 5, both)
    whole = docs_of(first + second)
    assert plain(line_dedup.drop_repeated_lines(whole, both, 5).collect()) == lines_by_hand(first + second, 10)
    assert plain(line_dedup.drop_repeated_lines(a, again, 5).collect()) == lines_by_hand(first, 10)
    facts = lambda s: plain((r.shard, bytes(r["keys"]), bytes(r.counts), bytes(r.repeated)) for r in s.collect())
    assert facts(again) == facts(one)
    texts = line_dedup.drop_repeated_lines(a, again, 5, texts=True).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in texts)


def test_a_common_line_is_asked_for_once_a_block(docs_of, odd_docs):
    docs = docs_of([(i, f"the common line\nline {i} of its own\n\nLINE {i // 20} of twenty") for i in range(4000)], parts=8)
    blocks = land(line_dedup._blocks(docs, 1))
    asked = line_dedup._asked(blocks, 16).collect()
    size = Counter()
    for r in asked:
        size[r.shard] += len(r["keys"]) // 16
    assert len(size) == 16 and max(size.values()) <= 2 * sorted(size.values())[8]
    assert len({(r.shard, r.block) for r in asked}) == len(asked) <= 16 * blocks.count()
    got = line_dedup.drop_repeated_lines(docs, line_dedup.insert(docs, 16), 16)
    assert plain(got.collect()) == lines_by_hand([(r.doc_id, r.text) for r in docs.collect()], 10)
    one = odd_docs.coalesce(1)
    assert plain(line_dedup.drop_repeated_lines(one, line_dedup.insert(one, 3, min_docs=2, min_chars=3), 3, min_chars=3).collect()) != []


def test_shards_grow_with_the_files_read(spark, docs_of, tmp_path, monkeypatch):
    docs = docs_of([(i, f"text {i} " * 50) for i in range(500)])
    few = common.shard_count(spark)
    assert common.shard_count(spark, docs) == few  # rows without files
    docs.write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    assert 0 < common.input_bytes(read) and common.shard_count(spark, read) == few
    monkeypatch.setattr(common, "SHARD_BYTES", common.input_bytes(read) // 30)
    assert common.shard_count(spark, read) >= 30
    whole = [(r.doc_id, r.text) for r in docs.collect()]
    for run in (exact_dedup.exact_duplicates, substring_dedup.drop_repeated_passages):
        assert plain(run(read).collect()) == plain(run(docs).collect()) and run(read).count() == len(whole)


def test_cuckoo_filter_loses_nothing():
    keys = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    held = line_dedup.CuckooFilter.sized(len(keys))
    assert held.insert(keys) and held.holds(keys).all()
    held.delete(keys[:1500])
    assert held.holds(keys[1500:]).all() and held.holds(keys[:1500]).mean() < 0.01
    small = line_dedup.CuckooFilter(np.zeros((8, 4), np.uint16))
    assert not small.insert(keys)


# --- passages -------------------------------------------------------------------------------------


def passages_by_hand(rows, least=50):
    first = {}
    for i, t in rows:
        for k in range(len(t) - least + 1):
            first[t[k : k + least]] = min(i, first.get(t[k : k + least], i))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - least + 1):
            if first[t[k : k + least]] < i:
                gone[k : k + least] = b"\1" * least
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return plain(out)


@pytest.mark.parametrize("batch", [200_000, 40])
def test_passages(docs_of, monkeypatch, batch):
    monkeypatch.setattr(substring_dedup, "BATCH", batch)
    rng = random.Random(3)
    some = ["".join(rng.choices("ab ", k=rng.randint(30, 120))) for _ in range(25)] + ["x" * 300, "abab" * 70, "é" * 60]
    rows = [(i, "".join(rng.choice(some) + rng.choice(["", "q", "zz"]) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1002, rows[5][1]), (1003, "short"), (1004, "short")]
    got = substring_dedup.drop_repeated_passages(docs_of(rows, 5), texts=True).collect()
    assert plain(tuple(r)[:5] for r in got) == passages_by_hand([(i, (t or "").encode()) for i, t in rows])
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_levels_grow_geometrically():
    rng = np.random.default_rng(0)
    family, seen = substring_dedup.Levels(8), {}
    for doc in range(40):
        data = rng.integers(97, 99, 30).astype(np.uint8)
        at = np.arange(23)
        got = family.add(family.suffixes(data, at), np.full(23, doc))
        for k in at:
            assert got[k] == seen.setdefault(data[k : k + 8].tobytes(), doc)
        sizes = [len(x) for x, _ in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_a_shard_holds_the_arrays_of_one_part_of_its_keys():
    rng = np.random.default_rng(4)
    head = np.zeros(3000, substring_dedup._HEAD)
    head["doc"], head["part"], head["size"] = rng.integers(0, 900, 3000), rng.integers(0, substring_dedup.PARTS, 3000), 70
    seen, last, of = [], None, {}
    for batch, family in substring_dedup._fed(head, head["size"].astype(np.int64) - 49, 50):
        part, docs = set(head["part"][batch].tolist()), head["doc"][batch]
        assert len(part) == 1 and of.setdefault(min(part), family) is family
        assert (np.diff(docs) >= 0).all() and (last is None or last[0] is not family or last[1] <= docs[0])
        last = (family, docs[-1])
        seen += batch.tolist()
    assert sorted(seen) == list(range(3000)) and len({id(f) for f in of.values()}) == substring_dedup.PARTS


@pytest.mark.parametrize("other", [1, 5, 9])
def test_passages_of_copies_read_by_falling_ids(spark, other):
    """Of copies in one task the smallest id is compared with the unlike text of another task, whichever is read first."""
    passage = "".join(random.Random(4).choices("abcdefghijklmnop", k=120))
    copies = [(i, "first " + passage + " last") for i in (8, 7, 3)]
    unlike = [(other, "another start of " + passage + " and end")]
    docs = spark.sparkContext.parallelize([copies, unlike], 2).flatMap(list).toDF("doc_id long, text string")
    got = substring_dedup.drop_repeated_passages(docs).collect()
    assert plain(got) == passages_by_hand([(i, t.encode()) for i, t in copies + unlike])


def test_passages_next_to_a_row_without_an_id(docs_of):
    passage = "a passage of more than fifty bytes that two documents have in common, "
    rows = [(None, passage + "x"), (1, passage + "one"), (2, passage + "two")]
    got = {r.doc_id: r.n_removed for r in substring_dedup.drop_repeated_passages(docs_of(rows, 1)).collect()}
    assert got == {None: 0, 1: 0, 2: len(passage)}


def test_passages_of_odd_rows(odd_docs, no_docs):
    got = substring_dedup.drop_repeated_passages(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    seven = next(r for r in got if r.doc_id == 7)
    assert seven.n_removed == seven.n_bytes - len("omega") and seven.n_spans == 1
    assert substring_dedup.drop_repeated_passages(no_docs).count() == 0


# --- n-grams --------------------------------------------------------------------------------------


def sets_by_hand(rows, width):
    out = {}
    for i, t in rows:
        words = [w for w in re.split(f"[{SPACE}]+", lower(t or "")) if w]
        k = min(width, len(words))
        out[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    return out


def near_by_hand(rows, width, num, den):
    sets = sets_by_hand(rows, width)
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    found = components(ids, links)
    return plain((i, len(sets[i]), found[i]) for i in ids)


@pytest.mark.parametrize("width,num,den,pivots,block", [(3, 9, 10, (1, 2, 2), 512), (5, 4, 5, (1, 1), 512), (3, 1, 2, (), 4), (2, 7, 10, (1,), 3)])
def test_similar_texts(docs_of, monkeypatch, width, num, den, pivots, block):
    """Families of variants, some of which link only through others; with few pivots and small blocks, too."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "PARTNERS", 3)
    rng = random.Random(width * 100 + num)
    words = [f"w{k}" for k in range(40)]
    rows, n = [(-1, None), (-2, ""), (-3, "one"), (-4, "ONE"), (-5, "one two"), (-6, " \n")], 0
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(4, 90))
        for _ in range(rng.randint(1, 12)):
            other = list(base)
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = rng.choice(words)
            rows.append((n, rng.choice([" ", "\n"]).join(other)))
            n += 1
            if rng.random() < 0.3:
                base = other
    got = ngram_join.similar_texts(docs_of(rows, 4), width=width, num=num, den=den, pivots=pivots)
    assert plain(got.collect()) == near_by_hand(rows, width, num, den)


def test_a_family_without_links_makes_no_list_of_pairs(docs_of, monkeypatch):
    """Variants that share most of their n-grams and still do not link: all are compared, but only pivots make pairs."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    made, filtered = [], ngram_join._filtered
    monkeypatch.setattr(ngram_join, "_filtered", lambda pairs, *rest: made.append(pairs.count()) or filtered(pairs, *rest))
    base = [f"w{k}" for k in range(44)]  # 40 n-grams, of which two variants share 35: a Jaccard of 35 / 45
    rows = [(n, " ".join([*base[:20], f"x{n}", *base[21:]])) for n in range(150)]
    rows += [(200 + n, f"{t} end") for n, t in rows if n % 50 == 7]  # only these link
    got = ngram_join.similar_texts(docs_of(rows, 4), pivots=(1,))
    assert plain(got.collect()) == near_by_hand(rows, 5, 4, 5)
    assert sum(made) < 5 * len(rows)


def test_sets_compared_in_tasks():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in rng.integers(0, 90, 30)] + [np.zeros(0, np.uint64)] * 2
    a, b = (x.ravel() for x in np.meshgrid(np.arange(32), np.arange(32)))
    want = [bool(len(sets[i]) and len(sets[j]) and 2 * len(np.intersect1d(sets[i], sets[j])) >= len(np.union1d(sets[i], sets[j]))) for i, j in zip(a, b)]
    assert ngram_join.Sets(sets).similar(a, b, 1, 2).tolist() == want


def test_an_id_of_unlike_texts_connects_what_they_link_with(docs_of):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(4, one + " x"), (9, one), (9, two), (7, two + " y"), (5, "alone here and now it is")]
    got = {(r.doc_id, r.component_id) for r in ngram_join.similar_texts(docs_of(rows)).collect()}
    assert got == {(4, 4), (9, 4), (7, 4), (5, 5)}


def test_components_of_few_rounds_are_connected(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 300)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)]
    want = components({x for p in links for x in p}, links)
    got = connected_components(spark.createDataFrame(links, "a long, b long").repartition(50), rounds=1).collect()
    assert len({r.id for r in got}) == len(got) and all(want[r.id] == want[r.component] for r in got)


def test_few_rows_start_few_python_tasks(spark, docs_of, monkeypatch):
    # Counted by marks that each task leaves, with many more partitions of a shuffle than the rows need.
    started = spark.sparkContext.accumulator(0)

    def counted(self, run, *args, of=type(spark.range(0)).mapInArrow, **kw):
        def marked(batches):
            started.add(1)
            yield from run(batches) or ()

        return of(self, marked, *args, **kw)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", counted)
    had = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    base = [f"f{f}w{i}" for f in range(6) for i in range(30)]
    docs = docs_of([(100 * f + k, " ".join([*base[30 * f : 30 * f + 30], *[f"x{f}y{k}"] * (k > 0)])) for f in range(6) for k in range(3)])
    try:
        for k, v in zip(had, ("120", "false")):
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in ngram_join.similar_texts(docs).collect()}
        assert got == {100 * f + k: 100 * f for f in range(6) for k in range(3)}
        assert 0 < started.value < 500
        begun = started.value
        links = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long").repartition(100)
        assert {r.component for r in connected_components(links).collect()} == {0}
        assert started.value - begun < 200
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)


def test_similar_odd_rows(odd_docs, no_docs):
    got = ngram_join.similar_texts(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r.component_id is None for r in got if r.doc_id is None)
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1} and {r.component_id for r in got if r.doc_id == 3} == {3}
    kept = ngram_join.drop_similar(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 2").count() == 0 and kept.where("doc_id is null").count() == 3
    assert ngram_join.similar_texts(no_docs).count() == 0 and ngram_join.drop_similar(no_docs).count() == 0


# --- embeddings -----------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [8192, 40])
def test_embeddings(spark, block):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(30, 16))
    vectors = np.concatenate([base[rng.integers(0, 30, 150)] + rng.normal(size=(150, 16)) * rng.choice([0, 0.2, 0.45], (150, 1)), np.repeat(base[:1], 20, axis=0)])
    vectors[5] *= 1e200
    vectors[6] *= 1e-200
    rows = [(i, v.tolist(), "label") for i, v in enumerate(vectors)]
    odd = [(900, None, ""), (901, [0.0] * 16, ""), (902, [float("nan")] * 16, ""), (903, [None] * 16, ""), (904, [float("inf")] * 16, ""), (905, [], ""), (None, [1.0] * 16, ""), (906, [1.0] * 3, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, unit string").repartition(4)
    got = {r.vec_id: tuple(r) for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    found = components(range(len(vectors)), np.argwhere(near).tolist())
    assert all(got[i] == (i, int(near[i].sum()), found[i], found[i] == i) for i in range(len(vectors)))
    assert all(got[i] == (i, 0, i, True) for i in range(900, 907)) and got[None] == (None, 0, None, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x = embedding_dedup.unit(rng.normal(size=(300, 24)))
    codes, scale, left = embedding_dedup.quantise(x)
    near = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale[None, :]
    assert (np.abs(x @ x.T - near) <= (1 + left[:, None]) * left[None, :] + left[:, None] + embedding_dedup.SLACK).all()
    i, j, again = embedding_dedup.tile_links(x, x, 0.3, True)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in np.argwhere(x @ x.T >= 0.3).tolist() if a < b}
    assert 0 < again < 300 * 299 / 2 / 10


def test_rows_of_one_lead_do_not_meet_before_they_have_shards(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROWS", 100)
    sizes = [(gram, cid, size, lead) for lead, grams, size in ((0, 400, 3), (10_000, 5, 10)) for gram in range(lead, lead + grams) for cid in range(lead, lead + size)]
    shared = spark.createDataFrame(sizes, "gram long, cid long, size long, lead long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        slotted = ngram_join._slotted(shared, shared)
        plan = slotted._jdf.queryExecution().executedPlan().toString()
        got = slotted.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted((r.gram, r.cid, r["size"], r.lead) for r in got) == sorted(sizes)
    assert {r.slot for r in got if r.lead == 0} == set(range(12)) and {r.slot for r in got if r.lead} == {0}
    assert all(len({r.slot for r in got if r.gram == g}) == 1 for g in range(400))
