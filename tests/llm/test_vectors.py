"""SimHash near-duplicates, centroid clusters and vector codes against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from casegraph.llm import clustering, queries, simhashdup, vectorcodes, vectors
from test_operators import components_of, sample_texts


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({x: x + 32 for x in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    """Least key reachable over links of three bits, for (key, mark) rows without null keys."""
    held = defaultdict(list)
    for k, m in marks:
        held[m].append(k)
    distinct = list(held)
    links = [(min(held[a]), min(held[b])) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= 3]
    links += [(min(v), k) for v in held.values() for k in v]
    return components_of(links, [k for k, _ in marks])


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("text", [*[x for x in sample_texts() if not x or len(x) < 20_000], "Ä B c d É", "a b c d e", "x", "x Y"])
def test_fingerprint_is_the_vote_of_its_shingles(text):
    assert simhashdup.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_over_pieces(monkeypatch):
    text = " ".join(f"w{i % 613}" for i in range(4000))
    want = simhashdup.fingerprint(text)
    monkeypatch.setattr("casegraph.llm.text._PIECE", 50)
    assert simhashdup.fingerprint(text) == want == plain_fingerprint(text)


def test_op11(spark, tmp_path):
    rng = random.Random(3)
    texts = sample_texts() + [None, "\n", "lone", "Lone"]
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts += [" ".join(words[:i] + ["other"] + words[i + 1 :]) for i in rng.sample(range(400), 40)]
    rows = [(i, x, "mine", 7, -1) for i, x in enumerate(texts)]
    folder = written(spark, tmp_path, "documents", rows, "doc_id long, text string, fingerprint string, mark int, n long")
    got = queries.QUERIES["op11_simhash_duplicates"](spark, folder).collect()
    marks = [(i, plain_fingerprint(x)) for i, x in enumerate(texts)]
    want = plain_components(marks)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == [(i, f"{m:016x}", want[i]) for i, m in marks]
    assert len({r.component_id for r in got}) < len({m for _, m in marks})
    equal = Counter(m for _, m in marks)
    assert all(r.n_equal == equal[int(r.fingerprint, 16)] for r in got)


def test_simhash_of_null_and_repeated_keys(spark):
    rows = [(None, "some words of a text"), (None, "some words of a text"), (5, "some words of a text"), (5, "some words of a text"), (None, "alone it stands here"), (8, None), (9, ""), (9, "")]
    got = simhashdup.simhash_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(None, 5): 2, (5, 5): 2, (None, None): 1, (8, 8): 1, (9, 8): 2})
    with pytest.raises(ValueError):
        simhashdup.simhash_duplicates(spark.createDataFrame(rows, "doc_id int, text string"), radius=4)


def dense_marks(seed, centres, each, flips):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        out |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(flips + 1))) for _ in range(each)}
    return sorted(out)


def plain_sets(marks):
    labels = components_of([(a, b) for a, b in itertools.combinations(marks, 2) if (a ^ b).bit_count() <= 3], marks)
    return {frozenset(v) for v in group(labels).values() if len(v) > 1}


def group(labels):
    out = defaultdict(set)
    for k, v in labels.items():
        out[v].add(k)
    return out


@pytest.mark.parametrize(("long", "looked_up", "centres"), [(1024, 4096, 12), (8, 4096, 12), (8, 40, 1)])
def test_index_over_sparse_and_dense_marks(spark, monkeypatch, long, looked_up, centres):
    monkeypatch.setattr(simhashdup, "LONG_POSTING", long)
    monkeypatch.setattr(simhashdup, "LOOKED_UP", looked_up)
    marks = dense_marks(4, centres, 60, 5) + dense_marks(5, 400, 1, 0)
    rows = [(m - (1 << 64) if m >> 63 else m,) for m in marks]
    got = simhashdup.linked_marks(spark.createDataFrame(rows, "mark long")).collect()
    assert {frozenset(v) for v in group({r.node % (1 << 64): r.component for r in got}).values()} == plain_sets(marks)


def test_looked_up_equals_tallied():
    rng = np.random.default_rng(2)
    rest = np.unique(rng.integers(0, 1 << 14, 900)).astype(np.int64)
    a = simhashdup.looked_up(rest, 14, 3)
    b = simhashdup.tallied(np.zeros(len(rest), np.int64), rest.view(np.uint64), 3)
    assert (a == b).all()


def test_a_dense_cluster_costs_its_size(spark):
    """Five thousand fingerprints around one centre give stars and not pairs."""
    marks = dense_marks(6, 1, 5000, 4)
    rows = [(m - (1 << 64) if m >> 63 else m,) for m in marks]
    got = simhashdup.linked_marks(spark.createDataFrame(rows, "mark long"))
    assert got.count() == len(marks) and got.select("component").distinct().count() == 1


def odd_vectors(n, width, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, width)], int(i) % 5 if i % 7 else None) for i in rng.permutation(n)]
    rows += [(n + i, rows[i][1], 1) for i in range(3)]  # equal vectors
    return rows


BAD = [(901, None, 1), (902, [], 1), (903, [None] + [0.1] * 63, 1), (904, [math.nan] + [0.1] * 63, 2), (905, [math.inf] * 64, None), (906, [0.5] * 63, 2)]


def floor_means(groups, x, before):
    out = [list(c) for c in before]
    for k in set(groups):
        own = [v for g, v in zip(groups, x, strict=True) if g == k]
        out[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return out


def best(x, entries):
    return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(entries))


def plain_clusters(rows):
    kept = [(k, [math.floor(64 * v) for v in e]) for k, e, _ in rows if e and len(e) == 64 and all(v is not None and math.isfinite(v) for v in e)]
    x = [v for _, v in kept]
    start = sorted(kept, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())[:16]
    c = [v for _, v in start]
    for _ in range(3):
        c = floor_means([best(v, c)[1] for v in x], x, c)
    last = [best(v, c) for v in x]
    sums = Counter()
    for d, k in last:
        sums[k] += d
    return sorted((k, n, d, sums[n], sum(sums.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (k, _), (d, n) in zip(kept, last, strict=True))


def test_op12(spark, tmp_path):
    rows = odd_vectors(150, 64) + BAD
    folder = written(spark, tmp_path, "embeddings", [(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, cluster int, distance string")
    got = queries.QUERIES["op12_centroid_clusters"](spark, folder).collect()
    assert sorted(map(tuple, got)) == plain_clusters(rows)


def test_fewer_vectors_than_centroids_and_vectors_out_of_range(spark):
    rows = [(1, [0.0] * 64), (2, [0.0] * 64), (3, [1.0] * 64), (None, [2.0] * 64), (4, [1e30] + [0.0] * 63)]
    got = {r.vec_id: r for r in clustering.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1].cluster == got[2].cluster and got[4].cluster is None and got[4].distance is None and got[4].inertia == 0
    assert len({got[k].cluster for k in (1, 3, None)}) == 3 and all(got[k].distance == 0 for k in (1, 2, 3, None))


@pytest.mark.parametrize("spread", [3, 60, 100_000, 1 << 27])
def test_screening_never_loses_the_nearest(spread):
    rng = np.random.default_rng(spread)
    c = rng.integers(-spread, spread + 1, (16, 64))
    c[9] = c[4]
    c[10] = c[4] + rng.integers(0, 2, 64)
    x = np.concatenate([rng.integers(-spread, spread + 1, (200, 64)), c, (c[:, None] + c[None]).reshape(-1, 64) // 2])
    number, distance = clustering.nearest(x, c)
    exact = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    if spread <= 100_000:  # intervals settle most
        assert clustering.screened(x[:200], c).sum() < 16 * 200 / 4


def plain_codes(rows):
    kept = [(k, [math.floor(256 * v) for v in e], y) for k, e, y in rows if e is not None and all(v is not None and math.isfinite(v) for v in e) and len(e) == 64]
    split = [[v[4 * p : 4 * p + 4] for p in range(16)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: kept[i][0])[:64]
    books = [[split[i][p] for i in first] for p in range(16)]
    for _ in range(2):
        books = [floor_means([best(s[p], books[p])[1] for s in split], [s[p] for s in split], books[p]) for p in range(16)]
    found = [[best(s[p], books[p]) for p in range(16)] for s in split]
    errors = [sum(d for d, _ in f) for f in found]
    sums = Counter()
    for (_, _, y), e in zip(kept, errors, strict=True):
        sums[y] += e
    mark = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((k, "".join(f"{n:02x}" for _, n in f), e, sums[y], mark) for (k, _, y), f, e in zip(kept, found, errors, strict=True))


def test_op13(spark, tmp_path):
    rows = odd_vectors(150, 64, 2) + BAD
    folder = written(spark, tmp_path, "embeddings", [(*r, "own", "x") for r in rows], "vec_id long, embedding array<float>, label int, code string, v string")
    got = queries.QUERIES["op13_vector_codes"](spark, folder).collect()
    assert sorted(map(tuple, got)) == plain_codes(rows)


def test_few_vectors_and_vectors_out_of_range_have_codes(spark):
    rows = [(1, [0.0] * 32, "a"), (2, [0.0] * 32, "a"), (3, [1.0] * 32, None), (None, [2.0] * 32, None), (4, [1e30] + [0.0] * 31, "a"), (5, [0.0] * 16, "a")]
    got = {r.vec_id: r for r in vectorcodes.compress_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got.keys() == {1, 2, 3, None, 4} and got[1].code == got[2].code == "00" * 16 and got[3].code == "02" * 16
    assert (got[4].code, got[4].error, got[4].label_error, got[None].error) == (None, None, 0, 0)
    odd = spark.createDataFrame([(1, [0.5] * 15, "a")], "vec_id long, embedding array<double>, label string")
    assert vectorcodes.compress_vectors(odd).count() == 0


@pytest.mark.parametrize("spread", [2, 50, 1 << 26])
def test_exponion_search_is_exact_from_any_start(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread + 1, (64, 4))
    entries[40] = entries[7]
    book = vectorcodes.Codebook(entries)
    parts = np.concatenate([rng.integers(-spread, spread + 1, (3000, 4)), entries, (entries[:32] + entries[32:]) // 2])
    exact = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    far, near = rng.integers(0, 64, len(parts)), exact.argmin(axis=1)
    cost = {}
    for name, before in (("far", far), ("near", near)):
        number, squared, cost[name] = book.search(parts, before)
        assert (number == near).all() and (squared == exact.min(axis=1)).all()
    assert cost["near"] < cost["far"] <= 65 * len(parts)


def test_exact_means_round_down(spark):
    counts, sums = vectors.summed(np.array([2, 0, 2]), np.array([[1, -1], [5, 5], [2, -2]]), 4)
    assert counts.tolist() == [1, 0, 2, 0] and sums.tolist() == [[5, 5], [0, 0], [3, -3], [0, 0]]
    rows = [(0, 2, [3, -3]), (0, 1, [1, 1]), (3, 1, [-7, 7])]
    assert vectors.means(spark.createDataFrame(rows, vectors.sums_schema())) == {0: [1, -1], 3: [-7, 7]}
