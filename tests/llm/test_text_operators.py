"""Pieces, SimHash, quality rules, decontamination and secrets against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evenkeel.llm import decontaminate, pieces, quality, secrets, simhash
from evenkeel.llm.components import components
from evenkeel.llm.queries import piece_model
from tests.llm.conftest import TEXTS

WORD = r"[^\x20\x09-\x0D]+"


# Pieces -----------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def test_encoding_equals_the_library(library):
    rng = random.Random(5)
    parts = ["a", "b", "ab", "  ", " ", "\n", "日", "é", "é", "12", "<s>", "▁", "\U0001f600", "aaaa", "th", "ing", "==", " " * 20, "\t", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("aabbcdein rst") for _ in range(150)) for _ in range(500)]
    texts += [c * k for c in ("a", " ", "=", "ab") for k in range(70)] + [" " * k + "hello" for k in range(60)] + [t or "" for t in TEXTS]
    own = pieces.model(piece_model())
    ids = own.encode(texts)
    assert [x.tolist() for x in ids] == library.encode(texts)
    assert [own.decode(x) for x in ids] == library.decode([x.tolist() for x in ids])


def test_decoding_of_any_ids(library):
    rng, own = random.Random(6), pieces.model(piece_model())
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999), 259]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids), ids
    with pytest.raises(ValueError):
        own.decode([32000])


def test_encode_keeps_rows_and_columns(spark, odd, none, library):
    name = pieces.ship(spark, piece_model())
    clash = odd.withColumn("ids", F.lit("mine"))
    got = pieces.encode(clash, name, ["doc_id", "ids"], decoded=True).collect()
    assert len(got) == odd.count() and {r.ids for r in got} == {"mine"}
    for row in got:
        if row.doc_id in (0,):
            assert row.ids_ is None and row.decoded is None
        elif row.doc_id is not None:
            assert row.ids_ == library.encode(TEXTS[row.doc_id])
    encoded = pieces.encode(odd, name)
    back = pieces.decode(encoded, name, "doc_id").collect()
    assert {(r.id, r.text) for r in back} == {(r.doc_id, r.text and r.text.replace("▁", " ")) for r in odd.collect()}
    assert pieces.encode(none, name).collect() == []


# SimHash ----------------------------------------------------------------------
def slow_print(text: str, size: int) -> int:
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    words = re.findall(WORD, low)
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints: dict, bits: int) -> dict:
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= bits and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_clusters_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 30, 200]))) for _ in range(60)]
    texts += [" ".join(t.split()[:-1] + ["Z"]) for t in texts[:40]] + texts[:10] + ["", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = {i: slow_print(t, 4) for i, t in enumerate(texts)}
    groups = slow_groups(want, 4)
    got = {r.id: (r.fp % 2**64, r.component_id) for r in simhash.clusters(docs).collect()}
    assert got == {i: (want[i], groups[i]) for i in want}
    # Tiny leaves, so that leaves of different depth meet.
    links = simhash.links(simhash.fingerprints(docs).select("fp").distinct(), 4, leaf_size=2)
    fps = {want[i] if want[i] < 2**63 else want[i] - 2**64 for i in want}
    roots = {r.vertex: r.root for r in components(links).collect()}
    same = Counter(groups[i] for i in {v: k for k, v in want.items()}.values())
    assert len(fps) - len(roots) + len(set(roots.values())) == len(same)


def test_trie_pairs_against_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)

    def near(x, k):
        for bit in rng.choice(64, k, replace=False):
            x = x ^ (np.uint64(1) << np.uint64(bit))
        return x

    a = np.unique([near(x, int(rng.integers(0, 6))) for x in [*base, *base[:1].repeat(200)]])
    b = np.unique([near(x, int(rng.integers(0, 6))) for x in base])
    for left, right in ((a, None), (a, b)):
        other = left if right is None else right
        close = np.bitwise_count(left[:, None] ^ other[None, :]) <= 4
        want = {(i, j) for i, j in zip(*np.nonzero(close)) if right is not None or i < j}
        got = [pair for i, j in simhash.near_pairs(left, right, 4) for pair in zip(i.tolist(), j.tolist())]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 150)]
    rows = spark.createDataFrame([*chain, *star, (7, 7), (None, 3)], "u long, v long")
    got = {r.vertex: r.root for r in components(rows).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}
    assert components(rows.limit(0)).collect() == []


def test_one_per_group(spark, odd, none):
    got = simhash.one_per_group(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    # Empty texts 0, 1, 2 are one group; the repeated row counts once; the nameless row stays.
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [0, 3, 4, 5, 6, 7, 8]
    assert sum(r.doc_id is None for r in rows) == 1
    assert simhash.one_per_group(none).collect() == [] and simhash.clusters(none).collect() == []


# Quality ----------------------------------------------------------------------
def slow_counts(text: str) -> tuple:
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_counts_against_brute_force(spark, odd, none):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a ", "b ", "c ", "a b c ", "# ", "\n", "\r", "\x0b", "é|"]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(odd.select("doc_id", "text"))
    rules = quality.QualityRules(min_words=5)
    rows = quality.measured(docs, [0.0] * rules.buckets, rules).select("row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
    for text, *got in rows.collect():
        counts = slow_counts(text or "")
        failed = counts[0] < 5 or 100 * counts[4] > 50 * counts[0]
        assert tuple(got) == (*counts, failed, not failed, 0.0), text
    assert quality.measured(none, [0.0] * rules.buckets, rules).collect() == []


def test_likelihood_ratio(spark, odd):
    import math

    good = [(i, "calm sea and clear sky over the bay " * 2) for i in range(20)]
    bad = [(100 + i, "@@@ ### buy | buy | now " * 3) for i in range(20)]
    docs = spark.createDataFrame(good + bad + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i,) for i in range(20)] * 2 + [(None,)], "doc_id long")
    rules = quality.QualityRules(min_words=1, max_repeat_percent=100, threshold=-0.2)
    weights = quality.fit(docs, labels, rules)
    kept = quality.kept(docs, weights, rules)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(20))
    assert quality.fit(docs, labels.limit(0), rules) == [0.0] * rules.buckets
    tiny = quality.QualityRules(buckets=3)
    want = [math.log((a + 1) / (5 + 3)) - math.log((b + 1) / (9 + 3)) for a, b in ((5, 6), (0, 3), (0, 0))]
    assert quality.ratios({0: (5, 6), 1: (0, 3)}, tiny) == [round(x, 4) for x in want]


def test_all_trusted_documents_count(spark):
    docs = spark.range(50_100).select(F.col("id").alias("doc_id"), F.lit("calm sea").alias("text"))
    rules = quality.QualityRules()
    assert quality.fit(docs, docs.select("doc_id"), rules) == [0.0] * rules.buckets


# Decontamination --------------------------------------------------------------
def slow_matches(text: str, items: dict, rules) -> dict:
    split = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t)]
    words, out = split(text), {}
    for item, other in items.items():
        own = split(other)
        n = min(rules.shingle, len(own))
        grams = lambda run: Counter(tuple(run[i : i + n]) for i in range(len(run) - n + 1))  # noqa: B023, E731
        for first in range(len(words) - len(own) + 1 if own else 0):
            sim = decontaminate.similarity(grams(own), grams(words[first : first + len(own)]))
            if sim >= rules.similarity and sim > out.get(item, (0,))[0]:
                out[item] = sim, first
    return out


def test_matches_against_brute_force(spark, odd, none):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(50)]
    passage = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: " ".join(passage(rng.choice([1, 3, 5, 12, 40, 60]))) for i in range(20)} | {20: "", 21: "tide tide"}
    texts = []
    for k in range(80):
        inside = items[k % 20].split()
        if k % 3 == 0 and len(inside) > 20:
            inside[rng.randrange(len(inside))] = "changed"
        texts.append(" ".join(passage(30) + [w.upper() + "," for w in inside] + passage(10)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(odd.select("doc_id", "text"))
    bench = spark.createDataFrame([*items.items(), (None, "low tide low tide low"), (99, None)], "item_id long, text string")
    rules = decontaminate.Decontamination()
    got = {(r.id, r.item_id): (r.similarity, r.first_token) for r in decontaminate.matches(docs, bench, rules).collect() if r.id is not None and r.item_id is not None}
    want, skewed = {}, 0
    for i, t in [*enumerate(texts), *((i, t or "") for i, t in enumerate(TEXTS))]:
        for item, found in slow_matches(t, items, rules).items():
            want.setdefault((i, item), found)
    ids = {k for k in want if k[0] >= len(TEXTS)}
    assert {k: v for k, v in got.items() if k in ids} == {k: want[k] for k in ids} and ids
    blocks = decontaminate.Decontamination(items_per_pass=5)
    assert {tuple(r) for r in decontaminate.matches(docs, bench, blocks).collect()} == {tuple(r) for r in decontaminate.matches(docs, bench, rules).collect()}
    clean = decontaminate.clean(odd, bench, rules)
    assert clean.columns == odd.columns and {r.doc_id for r in clean.collect()} == {None, 0, 1, 2, 3, 4, 6, 7}
    assert decontaminate.matches(none, bench, rules).collect() == [] and decontaminate.clean(odd, bench.limit(0), rules).count() == odd.count()


def test_documents_shorter_than_an_item(spark):
    rng, rules = random.Random(5), decontaminate.Decontamination()
    items = {i: " ".join(f"v{rng.randrange(50)}" for _ in range(n)) for i, n in enumerate([5, 6, 12, 38, 59])}
    docs, want = [], {}
    for text in items.values():
        for gone in (0, 1, 2, 8):
            docs += [text.split()[gone:], text.split()[: len(text.split()) - gone]]
    docs = [" ".join(words) for words in docs]
    for i, text in enumerate(docs):
        words = text.split()
        for item, other in items.items():
            own = other.split()
            n = min(rules.shingle, len(own))
            grams = lambda run: Counter(tuple(run[k : k + n]) for k in range(len(run) - n + 1))  # noqa: B023, E731
            for first in range(max(len(words) - len(own), 0) + 1):
                sim = decontaminate.similarity(grams(own), grams(words[first : first + len(own)]))
                if sim >= rules.similarity and sim > want.get((i, item), (0,))[0]:
                    want[i, item] = sim, first, min(len(words), len(own))
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.id, r.item_id): (r.similarity, r.first_token, r.n_tokens) for r in decontaminate.matches(table, bench, rules).collect()}
    assert got == want and sum(sim < 1 for sim, _, _ in want.values()) >= 6
    assert {r.doc_id for r in decontaminate.clean(table, bench, rules).collect()} == set(range(len(docs))) - {i for i, _ in want}


def test_block_tables_find_all_within_the_radius():
    rules, rng = decontaminate.Decontamination(), np.random.default_rng(3)
    known = decontaminate.Items([(i, f"alpha beta gamma delta epsilon zeta number {i} of the list") for i in range(30)], rules)
    for item in range(30):
        prints = known.prints[item] ^ rng.integers(0, 2**64, 500, dtype=np.uint64) & rng.integers(0, 2**64, 500, dtype=np.uint64)
        want = np.flatnonzero(np.bitwise_count(prints ^ known.prints[item]) <= rules.radius)
        assert known.within(prints, item).tolist() == want.tolist()


# Secrets ----------------------------------------------------------------------
def test_patterns():
    found = lambda t: [(secrets.KINDS[k], t[a:z]) for a, k, z, _ in secrets.patterns(t)]
    assert found('PassWord" : "abcdefgh1" token=short secret=ab12cd34') == [("assign", 'PassWord" : "abcdefgh1'), ("assign", "secret=ab12cd34")]
    assert found("AKIA" + "A" * 11) == [] and found("AKIA" + "A" * 12) == [("access", "AKIA" + "A" * 12)]
    assert found("g" + "ab" * 16 + "g" + "a" * 31) == [("hex", "ab" * 16)]
    assert found("é api_key=" + "0f" * 16) == [("assign", "api_key=" + "0f" * 16), ("hex", "0f" * 16)]
    assert found("toKen=abcdefg") == [] and found("password = token=abcdefgh") == [("assign", "password = token=abcdefgh")]


def test_scan_and_masks(spark, odd, none):
    rng = random.Random(9)
    token = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(40))
    prose = "the harbour lights were reflected in the water while the fishermen unloaded internationalisation " * 30
    texts = [prose, prose + token, 'secret: "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"', "x AKIA" + "Z9" * 8 + " y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    models = secrets.fit(docs.where("doc_id <> 1").union(odd.select("doc_id", "text")), secrets.SecretRules())
    got = {r.id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(docs, models).collect()}
    assert got[0] == [] and got[1] == [("markov", len(prose), len(prose) + 40)]
    assert [k for k, _, _ in got[2]] == ["assign", "hex"] and got[3] == [("access", 2, 22)]
    masked = {r.doc_id: r.text for r in secrets.redacted(docs, models).collect()}
    assert masked == {0: prose, 1: prose + "[secret]", 2: '[secret]"', 3: "x [secret] y"}
    same = secrets.redacted(odd, models)
    assert same.columns == odd.columns and sorted(map(tuple, same.collect()), key=repr) == sorted(map(tuple, odd.collect()), key=repr)
    assert secrets.scan(none, secrets.fit(none, secrets.SecretRules())).collect() == []


# Near copies of the pipeline --------------------------------------------------
def edited(rng: random.Random, words: list[str], n: int) -> str:
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def slow_similar(texts: list[str], size: int, least: float) -> list[int]:
    """The least position that pairs of that Jaccard similarity reach."""

    def grams(t):
        words = t.lower().split()
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())

    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(texts)):
        for a in range(b):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def test_near_copies_against_brute_force(spark, none):
    from evenkeel.llm import similar

    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([50, 120, 400, 900]))] for _ in range(60)]
    texts = [" ".join(b) for b in bases] + ["", " \n", "one two", "ONE two", "one three"]
    for b in bases:  # similarity from about 0.6 to 1
        texts += [edited(rng, b, max(1, round(len(b) * share))) for share in (0.0, 0.01, 0.018, 0.021, 0.024, 0.03, 0.05)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = slow_similar(texts, 5, 0.8)
    kept = {r.doc_id for r in similar.one_per_group(docs).collect()}
    assert kept == set(want)
    # Links that four bits over four words do not make.
    narrow = slow_groups({i: slow_print(t, 4) for i, t in enumerate(texts)}, 4)
    assert sum(narrow[i] != narrow[want[i]] for i in range(len(texts))) > 20
    assert similar.one_per_group(none).collect() == []


def test_near_copies_by_the_trie_alone(spark, monkeypatch):
    """Without the other steps, fingerprints up to four bits apart meet, and no others."""
    from evenkeel.llm import similar

    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    pairs = [(" ".join(b), edited(rng, b, 3)) for b in ([rng.choice(vocabulary) for _ in range(600)] for _ in range(60))]
    texts = [text for pair in pairs for text in pair]
    prints = [int(similar.signature(similar.shingle_set(t, 5))[3][0]) % 2**64 for t in texts]
    apart = [(prints[i] ^ prints[i + 1]).bit_count() for i in range(0, len(texts), 2)]
    assert sum(0 < d <= 4 for d in apart) > 10 and sum(d > 4 for d in apart) > 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    none = spark.range(0).select(*[F.col("id").alias(c) for c in "uv"])
    monkeypatch.setattr(similar, "_marked", lambda *_: none)
    monkeypatch.setattr(similar, "_candidates", lambda *_: none)
    gone = set(range(len(texts))) - {r.doc_id for r in similar.one_per_group(docs).collect()}
    assert gone == {2 * k + 1 for k, d in enumerate(apart) if d <= 4 and (d or texts[2 * k] == texts[2 * k + 1])}


def test_spanning_pairs():
    rng = np.random.default_rng(3)
    words = np.unique(rng.integers(0, 2**64, 30, dtype=np.uint64)[rng.integers(0, 30, 600)] ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)))
    u, v = simhash.spanning(simhash.near_pairs(words, None, 2), len(words))
    label = simhash.forest(simhash.near_pairs(words, None, 2), len(words))
    assert (np.bitwise_count(words[u] ^ words[v]) <= 2).all()
    assert len(u) == len(words) - len(set(label.tolist()))
    assert (simhash.forest(iter([(u, v)]), len(words)) == label).all()


def test_one_per_group_decides_by_row(spark):
    """Ids that repeat and ids that are null, with texts that have a near copy or none."""
    from evenkeel.llm import similar

    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (7, c, 4), (7, "x y", 5), (None, "p q", 6), (None, "p q", 7), (None, c, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").coalesce(1)
    for got in (simhash.one_per_group(docs), similar.one_per_group(docs)):
        assert got.columns == docs.columns
        assert {1, 3, 4, 5, 6} <= (places := {r.row for r in got.collect()}) and not {2, 7} & places
    assert 8 not in places
