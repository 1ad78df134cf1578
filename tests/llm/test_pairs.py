import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tenderspark.llm import descent, forest, groups, hnsw, lines
from tenderspark.llm.common import Scratch, read, texts
from tenderspark.llm.vectors import unit


def parts(n, pairs):
    root = {i: i for i in n}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def word_sets(rows):
    out = defaultdict(set)
    for d, t in rows:
        w = t.lower().split()
        out[d] |= {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_links(sets, threshold, by=None):
    ids = sorted(sets)
    by = by or (lambda i: 0)
    return [(a, b) for a, b in itertools.combinations(ids, 2) if by(a) == by(b) and jaccard(sets[a], sets[b]) >= threshold]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(150)] + [(5000, 5001 + k) for k in range(200)] + [(7, 7)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    got = {r["id"]: r["component"] for r in groups.components(df, Scratch(spark, "test")).collect()}
    want = parts({i for p in pairs for i in p}, pairs)
    assert got == {i: c for i, c in want.items() if any(i in p for p in pairs if p[0] != p[1])}
    assert groups.components(df.limit(0), Scratch(spark, "test")).count() == 0


def near_copies(rng, n, groups_of):
    """Texts with groups of copies that differ in a few words."""
    out = []
    for g in range(n):
        base = [f"t{rng.randint(0, 400)}" for _ in range(rng.randint(3, 120))]
        for _ in range(groups_of(g)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
            out.append(" ".join(words))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("block", [1 << 19, 600])
def test_jaccard_join_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", block)
    rows = near_copies(random.Random(5), 60, lambda g: 70 if g == 0 else g % 4 + 1)
    got = {r["doc_id"]: (r["component_id"], r["n_links"], r["kept"]) for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links = brute_links(word_sets(rows), 0.8)
    count, comp = Counter(i for p in links for i in p), parts({i for i, _ in rows}, links)
    assert got == {i: (comp[i], count[i], comp[i] == i) for i, _ in rows}


def test_jaccard_join_of_odd_rows(odd):
    got = forest.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: (r["component_id"], r["n_links"], r["kept"]) for r in got}
    assert by[4] == (4, 2, True) and by[5] == (4, 2, False) and by[9] == (4, 2, False)
    assert by[None] == (None, 0, True) and by[2] == (2, 0, True) and by[3] == (3, 0, True) and by[6] == (6, 0, True)
    left = forest.without_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 10]
    assert forest.near_duplicates(odd.limit(0)).count() == 0


def test_one_document_of_each_group_in_the_given_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = [tuple(r) for r in texts(docs).collect()]
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in forest.near_duplicates(docs).collect()}
    links = brute_links(word_sets(rows), 0.8)
    count, comp = Counter(i for p in links for i in p), parts({i for i, _ in rows}, links)
    assert links and got == {i: (comp[i], count[i]) for i, _ in rows}


def brute_lines(rows):
    """(doc, line) to take out."""
    sets = {}
    for d, t in rows:
        for k, s in enumerate(t.split("\n")):
            if s := " ".join(s.lower().split()):
                s = s.ljust(8, "\0")
                sets[d, k] = {s[i:i + 8] for i in range(len(s) - 7)}
    classes = defaultdict(list)
    for place, s in sets.items():
        classes[frozenset(s)].append(place)
    firsts = {min(p): s for s, p in classes.items()}
    comp = parts(set(firsts), [(a, b) for a, b in brute_links(firsts, 0.8)])
    return {p for s, ps in classes.items() for p in ps if comp[min(ps)] != p}


@pytest.mark.parametrize("block", [1 << 18, 200])
def test_lines_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(6)
    pool = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    rows = []
    for d in range(150):
        own = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(pool)
            if rng.random() < 0.4:
                s = s[:-1] + rng.choice("xyz ")
            own.append(rng.choice([s, s.upper(), "  " + s, ""]))
        rows.append((d, "\n".join(own)))
    got = lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], k) for r in got for k in r["removed"]} == brute_lines(rows)


def test_lines_of_odd_rows(odd):
    out = lines.dedup_lines(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    by = {r["doc_id"]: r["text"] for r in rows}
    assert by[8] == "something else here" and by[2] is None and by[3] == "" and by[1].endswith("of them")
    assert 5 not in by and by[None] is not None and by[7] == "a  b \n\n cé <|endoftext|> \U0001f600 "
    assert len(lines.dedup_lines(odd, drop_emptied=False).collect()) == odd.count()
    assert lines.dedup_lines(odd.limit(0)).count() == 0


def vector_rows(rng, n, dim=16):
    """Background, close groups, exact copies and pairs near the threshold."""
    x = rng.normal(size=(n, dim))
    for g in range(6):
        at = rng.choice(n, 25, replace=False)
        x[at] = rng.normal(size=dim) + rng.normal(size=(25, dim)) * (0.05 + 0.05 * g)
    x[:15] = x[0]
    return x.astype(np.float32).astype(float)


ODD_VECTORS = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [float("inf")] * 16),
               (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (None, [1.0] * 16)]


def test_near_vectors_equal_brute_force(spark):
    x = vector_rows(np.random.default_rng(6), 500)
    rows = [(i, v.tolist(), int(i % 3) if i % 50 else None, "x") for i, v in enumerate(x)] + [(i, v, 1, "x") for i, v in ODD_VECTORS] + [(3, x[3].tolist(), 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in descent.near_duplicate_vectors(df).collect()}
    u = unit(x)
    near = u @ u.T >= 0.93
    links = [(a, b) for a in range(500) for b in range(a) if near[a, b] and rows[a][2] is not None and rows[a][2] == rows[b][2]] + [(9006, 9007)]
    count, comp = Counter(i for p in links for i in p), parts(set(range(500)) | {9006, 9007}, links)
    want = {i: (count[i], comp[i], comp[i] == i) for i in comp} | {i: (0, i, True) for i, _ in ODD_VECTORS if i not in (9006, 9007)}
    assert got == want
    assert descent.near_duplicate_vectors(df.limit(0)).count() == 0


def test_hot_group_hides_no_lost_pairs(spark, monkeypatch):
    monkeypatch.setattr(descent, "TABLES", 2)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 32))
    x[:600] = x[0] + 0.1 * x[:600]
    u = unit(x)
    across = unit(u[600::2] - (u[600::2] * u[601::2]).sum(1)[:, None] * u[601::2])
    x[600::2] = 0.935 * u[601::2] + np.sqrt(1 - 0.935**2) * across  # pairs just above the threshold
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in descent.near_duplicate_vectors(df).collect()}
    assert sum(got[i] > 0 for i in range(600, 900)) >= 0.98 * 300


def test_tables_reach_the_recall_at_the_threshold():
    for bits in (4, 14, 20, 24):
        same = (1 - np.arccos(0.93) / np.pi) ** bits
        assert 1 - (1 - same) ** descent.tables_for(bits, 0.93, 0.99) >= 0.99
    # A node with a thousand links doesn't outweigh one whose only link is lost.
    assert descent.recall_of_nodes({1: (1000, 1000), 2: (1, 1)}, {1: 1000}) == 0


def test_nearest_against_brute_force(spark):
    x = vector_rows(np.random.default_rng(7), 900)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist())] + ODD_VECTORS
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("label", F.lit("l"))
    got = defaultdict(list)
    for r in hnsw.nearest(df, F.col("vec_id") % 9 == 0, k=5, shard_size=300).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    u, hit, total = unit(x), 0, 0
    assert set(got) == set(range(0, 900, 9))
    for q, found in got.items():
        assert [r for *_, r in found] == [1, 2, 3, 4, 5] and q not in [i for i, *_ in found]
        s = u @ u[q]
        for i, score, _ in found:
            assert abs(score - s[i]) < 1e-12
        want = sorted((i for i in range(900) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        hit, total = hit + len(set(want) & {i for i, *_ in found}), total + 5
    assert hit >= 0.95 * total
    assert [i for i, *_ in got[0]] == [1, 2, 3, 4, 5]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert hnsw.nearest(few, F.col("vec_id") == 0).count() == 2
    assert hnsw.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_queries_meet_shards_where_they_lie(spark, monkeypatch):
    """Neither the arrays of a shard nor queries are joined or shuffled; passes of few queries give what one pass gives."""
    x = vector_rows(np.random.default_rng(9), 400)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[70].tolist()), (9006, [1.0, 2.0]), (9007, [2.0, 4.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = hnsw.nearest(df, F.col("vec_id") % 3 == 0, k=5, shard_size=100)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" not in plan
    monkeypatch.setattr(hnsw, "QUERIES", 40)
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 16)
    passes = hnsw.nearest(df, F.col("vec_id") % 3 == 0, k=5, shard_size=100)
    key = lambda r: (r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9))
    assert sorted(map(key, whole.collect())) == sorted(map(key, passes.collect()))
    assert {(r["query_id"], r["vec_id"]) for r in passes.filter("query_id = 9006").collect()} == {(9006, 9007)}


def recall_in_one_graph(x, k=5):
    """Of the `k` nearest of every row by id, the share that a search of one graph over all rows finds."""
    u = unit(np.unique(x, axis=0))
    g = hnsw.build(u)
    hit = 0
    for a in range(0, len(u), 500):
        found = hnsw._best(u, np.arange(len(u))[:, None], u[a:a + 500], np.arange(a, min(a + 500, len(u))), g.search(u[a:a + 500], 96, 96), k)
        s = u[a:a + 500] @ u.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        want = np.argsort(-s, axis=1, kind="stable")[:, :k]
        got = found["vec_id"].reshape(-1, k)
        hit += sum(len(set(b) & set(c)) for b, c in zip(got.tolist(), want.tolist()))
    return hit / (len(u) * k), g


@pytest.mark.parametrize("rows", ["given", "random"])
def test_one_graph_finds_the_nearest(rows):
    if rows == "given":
        import pyarrow.parquet as pq

        lists = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist()
        x = np.array([v for v in lists if v and np.isfinite(np.array(v, dtype=float)).all() and any(v)], dtype=float)
    else:
        x = np.random.default_rng(3).normal(size=(8192, 16))
    recall, g = recall_in_one_graph(x)
    assert recall >= 0.95
    for level in g.links:
        for node, own in enumerate(level):
            own = own[own >= 0].tolist()
            assert len(set(own)) == len(own) and node not in own


def test_nearest_gives_every_query_its_rows(spark):
    df = read(spark, "/root/testdata/sf0.01", "embeddings")
    rows = hnsw.nearest(df, F.col("vec_id") % 50 == 0, k=5).groupBy("query_id").count().collect()
    assert len(rows) == df.filter("vec_id % 50 = 0").count() and {r["count"] for r in rows} == {5}


def test_equal_cosines_go_to_the_smaller_id(spark):
    # Different vectors of one direction, and of components whose squares overflow.
    rows = [(0, [1.0, 0.0]), (9, [2.0, 2.0]), (4, [4.0, 4.0]), (7, [0.5, 0.5]), (1, [0.0, 1.0]), (2, [2.0**700, 2.0**700]), (3, [2.0**-700, 2.0**-700])]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2, 3, 4, 7, 9] and len({r["score"] for r in got}) == 1


def test_blocks_hold_few_members_however_short(spark):
    """Time stamps hang together by the thousand and are short."""
    rows = [(k, "x", 1, 16, f"2024-01-{k % 28 + 1:02d} 10:{k % 60:02d}:{k % 59:02d}.{k:05d}") for k in range(3000)]
    members = spark.createDataFrame(rows, "id long, grp string, weight long, n long, text string")
    blocks = groups.in_blocks(members, "n", lines.BLOCK)
    assert blocks.groupBy("grp", "i", "j").count().agg({"count": "max"}).first()[0] <= 2.3 * groups.MEMBERS
    got = groups.compare_blocks(blocks, groups.jaccard_links(0.8, lines._sets)).groupBy("id").agg(F.sum("links").alias("links")).collect()
    sets = [{t[k:k + lines.SHINGLE] for k in range(len(t) - lines.SHINGLE + 1)} for *_, t in rows]
    want = Counter(i for i, j in itertools.combinations(range(600), 2) for i, j in ((i, j), (j, i)) if jaccard(sets[i], sets[j]) >= 0.8)
    assert all(r["links"] >= want[r["id"]] for r in got) and set(want) <= {r["id"] for r in got}


def test_components_of_binary_ids(spark):
    rng = random.Random(9)
    pairs = [(rng.randbytes(1) * 16, rng.randbytes(1) * 16) for _ in range(150)]
    want = parts({x for p in pairs for x in p}, pairs)
    got = {bytes(r["id"]): bytes(r["component"]) for r in groups.components(spark.createDataFrame(pairs, "a binary, b binary"), Scratch(spark, "test")).collect()}
    assert got == {i: c for i, c in want.items() if i in got} and len(got) >= len({x for p in pairs if p[0] != p[1] for x in p})


def test_a_text_longer_than_a_batch_loses_its_repeated_lines(spark):
    rng = random.Random(11)
    line = lambda: "".join(rng.choice("abcdefghijklmnop ") for _ in range(120))
    body = [line() for _ in range(80_000)]  # 9.7 MB
    rows = [(1, "\n".join(body)), (2, "\n".join([line(), body[7], body[79_999]])), (3, body[5])]
    got = {r["doc_id"]: r["removed"] for r in lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: [1, 2], 3: [0]}


def test_span_of_links_equals_brute_force():
    rng = np.random.default_rng(11)
    for n in (2, 3, 40, 300):
        base = [rng.integers(0, 1000, 60) for _ in range(4)]
        sets = []
        for k in range(n):
            x = base[k % 4].copy()
            x[:rng.integers(0, 16)] = rng.integers(1000, 1100 if k % 2 else 10**9)
            sets.append(np.unique(np.append(x, rng.integers(10**9, 2 * 10**9, rng.integers(0, 12))).astype(np.uint64))[:rng.integers(1, 80)])
        for t in (0.8, 0.5, 1.0):
            found = list(groups.jaccard_span(sets, t))
            assert parts(range(n), found) == parts(range(n), brute_links(dict(enumerate(map(set, map(np.ndarray.tolist, sets)))), t))
            assert len(found) < n and all(jaccard(set(sets[a].tolist()), set(sets[b].tolist())) >= t for a, b in found)


def test_large_group_of_lines_takes_no_look_at_all_pairs(monkeypatch):
    """Copies of a line with one place changed, and as many with two: near copies of a group that grows with the table."""
    rng = random.Random(3)
    base, seen = "".join(rng.choice("abcdefghij ") for _ in range(120)), []
    for k in range(3000):
        s = list(base)
        for at in [rng.randrange(120) for _ in range(1 + k % 2 * 3)]:
            s[at] = chr(0x4E00 + rng.randrange(20_000))
        seen.append("".join(s))
    hashes, start, count = lines._shingles(seen)
    sets = [np.unique(hashes[a:a + n]) for a, n in zip(start.tolist(), count.tolist())]
    looked, real = [], np.add.reduceat
    monkeypatch.setattr(groups.np, "add", type("Add", (), {"reduceat": staticmethod(lambda x, edge, **kw: looked.append(len(edge)) or real(x, edge, **kw))}))
    found = list(groups.jaccard_span(sets, 0.8))
    assert len(found) > 1000
    assert sum(looked) < 3000 * 3000 / 20


def test_bands_of_a_hot_line_are_dealt_once_a_batch(spark):
    docs = spark.createDataFrame([(d, "the very same line of text in all the documents") for d in range(300)], "doc_id long, text string")
    signed = list(lines._sign(iter(docs.select("doc_id", "text").toArrow().to_batches())))
    short = pa.array([7] * 300, pa.int64())
    batches = [pa.RecordBatch.from_arrays([short[:b.num_rows], b.column(3)], names=["line", "bands"]) for b in signed]
    dealt = list(lines._deal_bands(4)(iter(batches)))
    assert sum(len(x) for b in dealt for x in b["pairs"].to_pylist()) == lines.BANDS * 16
    assert [r.asDict() for r in lines.removed_lines(docs).orderBy("doc_id").limit(1).collect()] == [{"doc_id": 1, "removed": [0]}]
