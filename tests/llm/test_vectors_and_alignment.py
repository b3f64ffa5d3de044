"""Centroid clustering, near copies of embeddings and alignment of tokenizers against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from evenkeel.llm import alignment, centroids, pieces, vectors
from evenkeel.llm.queries import byte_model, op13_alignment, piece_model
from tests.llm.conftest import TEXTS

SCHEMA = "vec_id long, embedding array<float>, label int, id string, row int, x int"


# Centroids --------------------------------------------------------------------
def slow_centroids(rows: list[tuple], rules: centroids.CentroidRules) -> tuple[list, list]:
    """(id, cluster, distance) of every kept vector, and the centroids, with Python's own integers."""
    most = 1 << 27
    kept = [
        (i, [min(max(int(np.floor(min(max(rules.scale * float(x), -1e18), 1e18))), -most), most) for x in v])
        for i, v in rows
        if v is not None and len(v) == rules.dimensions and all(x is not None and np.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{rules.seed}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [list(x) for _, x in order[: rules.centroids]]

    def assigned():
        far = [[sum((a - b) ** 2 for a, b in zip(x, c)) for c in middle] for _, x in kept]
        return [(d.index(min(d)), min(d)) for d in far]

    for _ in range(rules.rounds):
        groups = defaultdict(list)
        for (k, _), (_, x) in zip(assigned(), kept):
            groups[k].append(x)
        for k, inside in groups.items():
            middle[k] = [sum(column) // len(inside) for column in zip(*inside)]
    return [(i, *a) for (i, _), a in zip(kept, assigned())], middle


def odd_vectors(n: int) -> list[tuple]:
    return [(100, None), (101, []), (102, [0.5] * (n - 1)), (103, [0.5] * (n - 1) + [None]), (104, [float("nan")] * n), (105, [float("inf")] + [0.0] * (n - 1)),
            (None, [0.25] * n), (1, [0.25] * n), (1, [-0.25] * n), (106, [0.0] * n), (107, [3e38] * n), (107, [3e38] * n)]


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rules = centroids.CentroidRules(centroids=7, rounds=4, dimensions=6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * 0.3]) for i in range(90)] + odd_vectors(6)
    df = spark.createDataFrame([(i, v, 0, "id", 1, 2) for i, v in rows], SCHEMA).repartition(5)
    found, final = centroids.clustered(df, rules)
    want, middle = slow_centroids(rows, rules)
    got = [tuple(r) for r in found.select("id", "cluster", "distance").collect()]
    assert Counter(got) == Counter(want) and final.tolist() == middle
    whole = centroids.described(found, final).collect()
    inertia = Counter()
    for _, k, d in want:
        inertia[k] += d
    for r in whole:
        total = sum(inertia.values())
        assert (r.cluster_inertia, r.inertia) == tuple(x if x < 2**63 else None for x in (inertia[r.cluster], total))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, middle[r.cluster])).encode()).hexdigest()
    assert len(whole) == len(want)


def test_ties_few_vectors_and_none(spark):
    rules = centroids.CentroidRules(centroids=40, dimensions=2)
    df = spark.createDataFrame([(i, [0.0, 0.0], 0, "", 0, 0) for i in range(5)], SCHEMA)
    found, final = centroids.clustered(df, rules)
    # Equal centroids: all rows go to the smallest number, the others are empty and stay.
    assert {(r.cluster, r.distance) for r in found.collect()} == {(0, 0)} and final.tolist() == [[0, 0]] * 5
    found, final = centroids.clustered(df.limit(0), rules)
    assert centroids.described(found, final).collect() == [] and final.shape == (0, 2)


def test_only_changed_components_are_multiplied():
    rng = np.random.default_rng(1)
    x, old = rng.integers(-99, 99, (50, 8)), rng.integers(-99, 99, (4, 8))
    new = old.copy()
    new[1, 3] += 5
    new[2] -= 1
    dots = centroids.moved(x @ old.T, x, old, new)
    assert (dots == x @ new.T).all()
    wrong = x @ old.T
    wrong[:, 0] += 1  # an unchanged centroid's products are kept as they are
    assert (centroids.moved(wrong, x, old, new)[:, 0] == wrong[:, 0]).all()


# Near copies of embeddings ----------------------------------------------------
def slow_near(rows: list[tuple], least: float) -> list[tuple]:
    fit = [v is not None and label is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for _, v, label in rows]
    links = defaultdict(set)
    with np.errstate(all="ignore"):
        for a in range(len(rows)):
            for b in range(a):
                (_, x, p), (_, y, q) = rows[a], rows[b]
                if fit[a] and fit[b] and p == q and len(x) == len(y):
                    x, y = (np.array(z, float) for z in (x, y))
                    x, y = x / np.abs(x).max(), y / np.abs(y).max()
                    if (x @ y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                        links[a].add(b)
                        links[b].add(a)
    out = []
    for a in range(len(rows)):
        seen, stack = {a}, [a]
        while stack:
            for b in links[stack.pop()] - seen:
                seen.add(b)
                stack.append(b)
        least_id = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((rows[a][0], len(links[a]), least_id, rows[a][0] == least_id))
    return out


def cloud(rng, n: int, d: int) -> list[tuple]:
    """Random vectors with copies, scaled ones, near ones on both sides of 0.98, a dense group and a chain."""
    base = rng.normal(size=(n, d))
    rows = [x for x in base] + [x for x in base[:20]] + [x * 4 for x in base[20:40]]
    for x in base[: n // 2]:
        e = rng.normal(size=d)
        rows.append(x / np.linalg.norm(x) + e / np.linalg.norm(e) * rng.uniform(0.02, 0.3))
    rows += [base[0] + rng.normal(size=d) * 0.05 for _ in range(60)]
    step = rng.normal(size=d) * 0.2
    rows += [base[1] + step * k for k in range(8)]
    return [(i, [float(np.float32(z)) for z in x], i % 3 if i < n else 0) for i, x in enumerate(rows)]


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = cloud(rng, 240, 16)
    odd = [(i, v, 0) for i, v in odd_vectors(16)] + [(200, [0.25] * 16, None), (None, [0.25] * 16, 0), (201, [0.5] * 15, 0), (202, [1.0] * 15, 0), (203, [2.0], 1), (204, [-2.0], 1), (205, [5.0], 1)]
    rows = rows + [(None if i is None else i + 1000, v, label) for i, v, label in odd]
    df = spark.createDataFrame([(i, v, label, "id", 1, 2) for i, v, label in rows], SCHEMA).repartition(5)
    want = Counter(slow_near(rows, 0.98))
    # The reach that covers every pair, and blocks so small that grid rows are split.
    rules = vectors.VectorRules(block=16, sigmas=100.0, per_cell=4)
    assert Counter(map(tuple, vectors.near_copies(df, rules).collect())) == want
    usual = Counter(map(tuple, vectors.near_copies(df).collect()))
    assert sum(n for _, n, _, _ in usual.elements()) >= 0.98 * sum(n for _, n, _, _ in want.elements())
    assert vectors.near_copies(df.limit(0)).collect() == []
    assert {tuple(r) for r in vectors.near_copies(df.where("label is null")).collect()} == {(1200, 0, 1200, True)}


def test_recall_on_the_given_vectors(spark):
    """The given vectors with near copies of a third of them, most of them close to the bound."""
    from evenkeel.llm.common import new_folder
    from evenkeel.llm.queries import op12_near_vectors

    given, rng = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), np.random.default_rng(6)
    rows = [(r.vec_id, r.embedding, r.label) for r in given.collect()]
    for k, (_, v, label) in enumerate(rows[::3]):
        v, e = np.array(v), rng.normal(size=len(v))
        e -= v * (e @ v) / (v @ v)
        angle = np.arccos(rng.uniform(0.975, 0.99))
        rows.append((10**6 + k, [float(z) for z in np.cos(angle) * v + np.sin(angle) * e / np.linalg.norm(e)], label))
    sf = new_folder(spark, "near-vectors")
    spark.createDataFrame(rows, given.schema).write.parquet(f"{sf}/embeddings.parquet")
    got = {r.vec_id: r for r in op12_near_vectors(spark, sf).collect()}
    x, label = np.array([np.float32(v) for _, v, _ in rows], float), np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    assert near.sum() > 400 and all(got[r[0]].n_links <= n for r, n in zip(rows, near.sum(axis=1)))
    assert sum(r.n_links for r in got.values()) >= 0.99 * near.sum()


def test_traversal_visits_nearest_cells_first():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = vectors.Grid((vectors.codebook(x[:, :4], 8, 5), vectors.codebook(x[:, 4:], 8, 5)), 0.2)
    far = [((x[:, None, p] - book[None]) ** 2).sum(axis=2) for p, book in zip((slice(0, 4), slice(4, 8)), grid.books)]
    want = set()
    for n in range(len(x)):
        whole = far[0][n][:, None] + far[1][n][None, :]
        for i, j in zip(*np.nonzero(whole - whole.min() <= 0.2 + 1e-12)):
            if i * 8 + j >= grid.cells(x[n : n + 1])[0]:
                want.add((n, int(i), int(j)))
    got = [(n, i, int(j)) for n, i, seconds in grid.visits(x) for j in seconds]
    assert len(got) == len(set(got)) and set(got) == want


# Alignment --------------------------------------------------------------------
@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(byte_model())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=piece_model())


def slow_tokens(text: str | None, libraries) -> tuple[list, list]:
    """(id, bytes) of both sides, from the libraries' own offsets and pieces."""
    if not text:
        return [], []
    letters = {c: b for c, b in alignment._byte_letters().items()}
    a, b = libraries
    found = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(letters[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = b" " + text.encode()
    return (left, right) if all(b"".join(t for _, t in side) == whole for side in (left, right)) else ([], [])


def slow_alignment(texts: list, libraries) -> list[tuple]:
    rows, documents = [], Counter()
    for text in texts:
        sides = slow_tokens(text, libraries)
        spans = []
        for side in sides:
            at, own = 0, []
            for i, t in side:
                own.append((i, at, at + len(t)))
                at += len(t)
            spans.append(own)
        links = [(i, j) for i, p, q in spans[0] for j, r, s in spans[1] if p < s and r < q]
        cuts = sorted({q for _, _, q in spans[0]} & {s for _, _, s in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, p, q in own if low <= p and q <= cut) for own in spans))
            low = cut
        rows.append((len(spans[0]), len(spans[1]), len(groups), links, ";".join(groups)))
        documents.update(set(links))
    most = defaultdict(int)
    for (i, _), n in documents.items():
        most[i] = max(most[i], n)
    return [
        (n_a, n_b, n, len(links), sum(documents[x] == most[x[0]] for x in links), sum(documents[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if n_a else "")
        for n_a, n_b, n, links, text in rows
    ]


def random_texts(n: int) -> list[str]:
    rng = random.Random(7)
    parts = ["the ", "harbour", " light", "s", "\n", "  ", "日本", "é", "naïve ", "12", "345 ", "<|endoftext|>", "<s>", "<0x41>", "aaaa", "\U0001f600", "\t", "==", "\0", "ing ", "'ll"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(n)] + ["a▁b", "▁", "x" * 400, " " * 70, " lead", "tail "]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most_shipped", [1 << 20, 0])
def test_alignment_against_brute_force(spark, libraries, most_shipped):
    texts = random_texts(250) + TEXTS
    docs = spark.createDataFrame([(i, t, "fp", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, pairs string, row int, n int").repartition(4)
    names = [pieces.ship(spark, p) for p in (byte_model(), piece_model())]
    rules = alignment.AlignRules(block=300, plain_limit=390, most_shipped=most_shipped)
    got = {r.id: tuple(r[c] for c in COLUMNS) for r in alignment.scored(docs, *names, rules).collect()}
    want = slow_alignment(texts, libraries)
    assert [got[i] for i in range(len(texts))] == want
    assert want[250] == want[len(texts) - len(TEXTS)] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_of_repeated_rows_and_none(spark, odd, none, libraries):
    names = [pieces.ship(spark, p) for p in (byte_model(), piece_model())]
    rows = odd.collect()
    want = slow_alignment([r.text for r in rows], libraries)
    got = alignment.scored(odd, *names).collect()
    assert Counter((r.id, *(r[c] for c in COLUMNS)) for r in got) == Counter((r.doc_id, *w) for r, w in zip(rows, want))
    assert alignment.scored(none, *names).collect() == []


def test_the_query_on_whole_documents(spark, libraries):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").select("doc_id", "text")
    whole = {r.doc_id: r for r in op13_alignment(spark, sf).collect()}
    assert len(whole) == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = docs.collect()
    for r, want in zip(rows, slow_alignment([r.text for r in rows], libraries)):
        got = whole[r.doc_id]
        assert (got.n_a, got.n_b, got.n_groups, got.n_links, got.groups_sha256) == (*want[:4], want[6])


def test_crossings_of_any_ends():
    rng = random.Random(3)
    for _ in range(2000):
        n = rng.randint(1, 40)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}) for _ in "ab")
        if rng.random() < 0.5:  # long one-to-one stretches around one odd place
            k = rng.randrange(n)
            a, b = list(range(1, n + 1)), [x for x in range(1, n + 1) if x != k or x == n]
        starts = [[0, *ends[:-1]] for ends in (a, b)]
        want = {(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i] and a[i] != b[j]}
        x, y = alignment.crossings(a, b)
        assert list(zip(x, y)) == sorted(want)
    assert alignment.crossings([], []) == ([], [])
