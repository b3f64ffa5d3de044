"""Toxicity, archive, sharding, licences, URLs and the pipeline against brute force."""

from __future__ import annotations

import math
import dataclasses
import glob
import gzip
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from evenkeel.llm import licenses, sharding, toxicity, urls, warc
from evenkeel.llm.common import new_folder

SF = "/root/testdata/sf0.01"


# Toxicity ---------------------------------------------------------------------
def test_risk_is_corrected_for_the_prior():
    """One feature that marks positives, one that both classes have; unlabelled rows hold positives too."""
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    marks = lambda y: np.stack([(rng.random(len(y)) < np.where(y, 0.9, 0.02)), rng.random(len(y)) < 0.5], axis=1).astype(float)
    rules = toxicity.ToxicityRules()
    w, b = toxicity.train(marks(np.ones(800, bool)), marks(truth), 0.3, rules)
    chance = 1 / (1 + np.exp(-(np.array([0, w[0]]) + b + w[1] / 2)))
    # Bayes: 0.03 / (0.03 + 0.686) without the mark, 0.27 / (0.27 + 0.014) with it.
    assert abs(chance[0] - 0.04) < 0.04 and abs(chance[1] - 0.95) < 0.05 and abs(w[1]) < 1


def test_toxicity_on_held_out_rows(spark, odd, none):
    from evenkeel.llm.queries import op1_toxicity

    sf = SF.replace("0.01", "0.1")
    got = op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert got[got.toxic == 1].predicted.mean() > 0.7 and got[got.toxic == 0].predicted.mean() < 0.01
    rules = toxicity.ToxicityRules()
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (3, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, rules)
    assert toxicity.scored(odd, model, rules).count() == odd.count() and toxicity.scored(none, model, rules).collect() == []
    # Without labels the score is the logistic function at -40, whose last digit depends on the machine.
    assert all(math.isclose(r.score, 4.248354255291589e-18, rel_tol=1e-12) for r in toxicity.scored(odd, toxicity.fit(odd, labels.limit(0), rules), rules).collect())


# Archive ----------------------------------------------------------------------
def test_archive_round_trip(spark):
    big, other = "<p>" + "é" * 60, "x" * 100
    rows = [(5, "http://a/", big), (2, "http://b/\r\nWARC-Refers-To: <urn:page:9>", big), (7, None, big), (3, "u", "small"), (1, "u", "small"),
            (4, "u", None), (6, "u", ""), (8, "u", other), (8, "u", other), (9, "u", other), (None, "u", other), (10, "u", "a\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = new_folder(spark, "test-archive")
    warc.write(pages, path)
    least = {big: 2, other: 8}
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        first = least.get(html)
        target = first if first is not None and page != first else None
        want[(page, "response" if target is None else "revisit", target, hashlib.sha256(data).hexdigest(), len(data))] += 1
    assert Counter(tuple(r) for r in warc.index(spark, path).collect()) == want
    assert spark.read.parquet(f"{path}/payloads").count() == len({html or "" for _, _, html in rows})
    full = warc.records(spark, path).collect()
    assert Counter(bytes(r.payload).decode() for r in full) == Counter(html or "" for _, _, html in rows)
    warc.export(spark, path, f"{path}/files")
    local = f"{path}/files".removeprefix("file:")
    raw = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{local}/*.gz")))
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)
    back = warc.parse(spark, f"{path}/files/*.gz").collect()
    assert Counter(r.header.encode() + bytes(r.payload) for r in back) == Counter(bytes(r.record) for r in full)
    assert sum("WARC-Refers-To: <urn:page:9>" in r.header.split("\r\n") for r in back) == 0
    empty = new_folder(spark, "test-archive")
    warc.write(pages.limit(0), empty)
    assert warc.index(spark, empty).collect() == [] == warc.records(spark, empty).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("archive_")]


def test_archive_of_many_copies_moves_payloads_once(spark):
    """Payloads with more records than a part has, long and short ones; only headers are shuffled when it is read."""
    copies = 2 * warc._HOT + 5
    html = F.when(F.col("id") < copies, F.lit("x" * 150)).when(F.col("id") < 2 * copies, F.lit("short")).otherwise(F.concat(F.lit("y" * 120), F.col("id").cast("string")))
    pages = spark.range(2 * copies + 50).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), html.alias("html"))
    path = new_folder(spark, "test-archive")
    warc.write(pages, path)
    whole = warc.records(spark, path)
    found = whole.select("key", "record_type", "refers_to", F.col("payload").cast("string").alias("p"), F.octet_length("record").alias("n"), "header_bytes").collect()
    want = {r.page_id: r.html for r in pages.collect()}
    assert len(found) == len(want) and {r.key: r.p for r in found} == want
    for r in found:
        revisit = 0 < r.key < copies
        assert (r.record_type, r.refers_to) == (("revisit", 0) if revisit else ("response", None))
        assert r.n - r.header_bytes == (0 if revisit else len(r.p))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    for node in plan.split("\n"):
        if "Exchange" in node and "payload" in node:
            assert "part" in node


# Sharding ---------------------------------------------------------------------
def slow_shards(rows: list[tuple], limit: int) -> dict:
    """The shard of each distinct key by splitting buckets one bit at a time."""
    key = {k: int(hashlib.md5(str(k if k is not None else "").encode()).hexdigest()[:15], 16) for k, _ in rows}
    out, buckets = {}, [("", list(rows))]
    while buckets:
        prefix, inside = buckets.pop()
        if not inside:
            continue
        if sum(n for _, n in inside) <= limit or len(inside) == 1 or len({key[k] for k, _ in inside}) == 1 and len(prefix) == 60:
            for k, _ in inside:
                out[k] = prefix
            continue
        for bit in "01":
            buckets.append((prefix + bit, [(k, n) for k, n in inside if f"{key[k]:060b}"[len(prefix)] == bit]))
    return out


def test_shards_against_splitting_one_by_one(spark, odd, none):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 10, 300, 5000])) for i in range(400)] + [(None, 7), (1000, 9000)]
    docs = spark.createDataFrame([(k, "x" * n) for k, n in rows], "doc_id long, text string").repartition(6)
    got = sharding.assigned(docs, sharding.ShardRules(limit=4000)).collect()
    assert {r.id: r.shard for r in got} == slow_shards(rows, 4000)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += dict(rows)[r.id]
    assert all(sizes[r.shard] == r.shard_bytes and len(r.shard) == r.depth for r in got)
    assert {r.shard for r in sharding.assigned(odd, sharding.ShardRules()).collect()} == {""}
    assert sharding.assigned(none, sharding.ShardRules()).collect() == []


def test_directories_of_several_blocks_and_of_any_size(spark, monkeypatch):
    """Blocks of three bits, so that buckets are split over many passes; the directory shipped and not."""
    monkeypatch.setattr(sharding, "_BLOCK", 3)
    rows = [(i, 10) for i in range(300)] + [(7, 10)] * 40
    docs = spark.createDataFrame([(k, "x" * n) for k, n in rows], "doc_id long, text string").repartition(4)
    want = slow_shards([r for r in rows if r[0] != 7], 60)
    for shipped in (1 << 18, 0):
        got = sharding.assigned(docs, sharding.ShardRules(limit=60, most_shipped=shipped)).collect()
        hot = [r for r in got if r.id == 7]
        assert len(got) == len(rows) and len(hot) == 41 and all("+" in r.shard and r.shard_bytes <= 60 for r in hot)
        # Beside the hot key's path all other keys lie as without it, or deeper where they share that path.
        assert all(r.shard.startswith(want[r.id]) and r.shard_bytes <= 60 for r in got if r.id != 7)


def test_hot_key_is_split_further(spark):
    docs = spark.range(900).select(F.when(F.col("id") < 600, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("y" * 10).alias("text")).repartition(4)
    got = sharding.assigned(docs, sharding.ShardRules(limit=200)).collect()
    assert len(got) == 900 and max(Counter(r.shard for r in got).values()) <= 20
    assert all(r.shard_bytes <= 200 for r in got) and sum("+" in r.shard for r in got) == 600


def test_written_shards_hold_every_row_once(spark, odd):
    docs = spark.range(900).select(F.expr("case when id < 300 then 1 when id >= 600 then id end").alias("doc_id"), F.col("id").alias("n"), F.lit("y" * 10).alias("text"))
    path = new_folder(spark, "test-shards")
    sharding.write(docs.repartition(4), path, sharding.ShardRules(limit=200))
    got = sharding.read(docs, path).collect()
    assert sorted((r.n, r.doc_id) for r in got) == sorted((r.n, r.doc_id) for r in docs.collect())
    assert max(Counter(r.shard for r in got).values()) <= 20 and sum("+" in r.shard for r in got) == 600
    one, before = new_folder(spark, "test-shards"), odd.columns
    sharding.write(odd, one, sharding.ShardRules())
    assert sharding.read(odd, one).columns == sharding.read(odd, one).columns == [*before, "shard"] and odd.columns == before
    assert sorted(map(repr, sharding.read(odd, one).drop("shard").collect())) == sorted(map(repr, odd.collect()))


# Licences ---------------------------------------------------------------------
def test_licences(spark, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    mit = licenses.TEMPLATES["MIT"][1].split()
    gpl = licenses.TEMPLATES["GPL"][1].split()
    fixed = {"This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "All rights reserved.": "Proprietary"}
    prose = [w for r in docs.orderBy("doc_id").limit(200).collect() for w in r.text.split() if not any(line in r.text for line in fixed)]
    long = (prose * 20)[:20_000]
    extra = [
        ("Licensed under the apache license, version 2.0\nordinary words here", {(0, "Apache-2.0")}),
        ("a license to fish in this river", set()),
        (None, set()),
        ("", set()),
        ("Intro.\n\n" + " ".join(mit[:9]) + "\n" + " ".join(mit[9:]), {(1, "MIT")}),  # wrapped
        ("x\r\n \r\n# " + " ".join(gpl[:7]) + "\r\n# " + " ".join(gpl[7:15]) + "\r\n# " + " ".join(gpl[15:]) + " for more", {(1, "GPL")}),
        (" ".join(long[:9_000] + mit + long[9_000:]), {(0, "MIT")}),  # in the middle of one long line
        (" ".join(long[:50] + mit + long[50:90] + gpl + long[90:120]), {(0, "MIT"), (0, "GPL")}),
        (" ".join(w for w in mit if w != "charge,"), {(0, "MIT")}),
        (" ".join(mit[:8]), set()),
    ]
    rows = [(10**6 + i, t) for i, (t, _) in enumerate(extra)] + [(None, "SPDX-License-Identifier: MIT")] * 2
    more = spark.createDataFrame([(i, t, "p", 0, "f") for i, t in rows], "doc_id long, text string, paragraph string, row int, family string")
    rules = licenses.LicenseRules()
    found = licenses.scan(docs.unionByName(more, allowMissingColumns=True), licenses.fit(docs, rules), rules).collect()
    want = {(r.doc_id, fixed[line]) for r in docs.collect() for line in r.text.split("\n") if line in fixed}
    assert {(r.id, r.family) for r in found if r.id is not None and r.id < 10**6} == want
    for i, (text, names) in enumerate(extra):
        assert {(r.paragraph, r.family) for r in found if r.id == 10**6 + i} == names, text
    assert sum(r.id is None and r.family == "MIT" for r in found) == 2
    assert licenses.scan(none, licenses.fit(none, rules), rules).collect() == []


def test_licence_regression_against_numpy(spark):
    """Gradient steps and probabilities from the same rows, with plain loops over arrays."""
    rng, n, k = np.random.default_rng(2), 6, len(licenses.FAMILIES)
    data = [(int(rng.integers(k)), sorted(rng.choice(n, rng.integers(0, 5), replace=False).tolist()), int(rng.integers(5, 9)), int(rng.integers(1, 4))) for _ in range(40)]
    rows = spark.createDataFrame(data, "family int, features array<int>, total int, n long")
    counts = Counter()
    for family, _, _, times in data:
        counts[family] += times
    weights, bias, rules = [[0.0] * k for _ in range(n)], [0.0] * k, licenses.LicenseRules()
    w, b = np.zeros((n, k)), np.zeros(k)
    for _ in range(3):
        licenses.step(rows, dict(counts), weights, bias, rules)
        gw, gb, seen = np.zeros((n, k)), np.zeros(k), set()
        for family, features, total, times in data:
            logits = b + sum((w[f] for f in features), np.zeros(k)) / np.sqrt(total)
            p = np.exp(logits) / np.exp(logits).sum()
            p[family] -= 1
            gb += p * times / (counts[family] * len(counts))
            for f in features:
                gw[f] += p * times / (counts[family] * len(counts)) / np.sqrt(total)
                seen.add(f)
        b -= rules.rate * gb
        for f in seen:
            w[f] = w[f] * (1 - rules.decay) - rules.rate * k * gw[f]
    assert np.allclose(weights, w, atol=1e-4) and np.allclose(bias, b, atol=1e-4)


def test_licence_model_learns_from_all_documents(spark, monkeypatch):
    """Every run of every document is in the rounds or held out, in one batch or in several."""
    rng = np.random.default_rng(5)
    words = ["the", "software", "of", "this", "any", *[f"w{i}" for i in range(40)]]
    texts = [" ".join(rng.choice(words, 100)) for _ in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = {" ".join(t.split()[at : at + 32]) for t in texts for at in range(0, 100, 32)}
    rules, vocabulary = licenses.LicenseRules(), licenses.Vocabulary(spark)
    rows = licenses._negatives(docs, vocabulary, rules, "doc_id", "text")
    # What the general functions give for the same runs and stretches.
    plain = licenses._stretches(licenses._paragraphs(docs, "doc_id", "text").select("words"), vocabulary, rules)
    plain = plain.union(spark.createDataFrame([(t.split()[at : at + 32],) for t in texts for at in range(0, 100, 32)], "words array<string>"))
    triples = licenses._literal(vocabulary.triples, "bigint")
    plain = licenses._only(plain.withColumn("shared", F.arrays_overlap(licenses._grams(3), triples)), ["words"], ~F.col("shared"))
    plain = licenses._featured(plain, vocabulary).select(F.array_sort("features"), "total")
    assert Counter((*r.features, -1, r.total) for r in rows.collect()) == Counter((*f, -1, total) for f, total in plain.collect())
    want, step = rows.where("not held").count(), licenses.step
    assert want > len(runs) / 2
    for batch, batches in ((10**6, 1), (10, 12)):
        seen = []
        monkeypatch.setattr(licenses, "step", lambda rows, *rest: (seen.append(rows.where(F.col("family") == licenses._UNKNOWN).agg(F.sum("n")).first()[0]), step(rows, *rest)))
        licenses.fit(docs, licenses.LicenseRules(batch=batch))
        assert len(seen) == rules.rounds and np.isclose(sum(seen[:batches]), want)


# URLs -------------------------------------------------------------------------
def test_parts_and_rules(spark):
    from evenkeel.llm.queries import URL_RULES

    cases = [
        ("http://A.Net/x?y", "a.net", "/x", "net/", "block"),
        ("http://b.example.net/en/1#z", "b.example.net", "/en/1", "example.net/en/", "allow"),
        ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("http://myexample.com/de/", "myexample.com", "/de/", None, "allow"),
        ("http://É.org/fr/a://b/", "É.org", "/fr/a://b/", "org/fr/", "allow"),
        ("http://c.net", "c.net", "", None, "allow"),
        ("net/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://?q", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], None, "h") for i, c in enumerate(cases)] + [(0, cases[0][0], None, "h")], "page_id long, url string, html string, host string")
    got = sorted(tuple(r)[:5] for r in urls.judged(pages, URL_RULES).collect())
    assert got == sorted([(i, *c[1:]) for i, c in enumerate(cases)] + [(0, *cases[0][1:])])
    assert urls.judged(pages.limit(0), URL_RULES).collect() == []


def test_walks_against_brute_force(spark):
    rng = random.Random(8)
    hosts = [f"h{i}.example.{t}" for i in range(12) for t in ("com", "net", "org")]
    pages = []
    for i in range(300):
        here, links = rng.choice(hosts), [rng.choice(hosts) for _ in range(rng.randint(0, 4))]
        html = "".join(f'<a href="{rng.choice(["http:", "HTTPS:", ""])}//{h.upper()}/x">' for h in links) + '<img src="/own">'
        pages.append((i, f"http://{here}/{rng.choice(['en', 'de', 'fr'])}/", html))
    from evenkeel.llm.queries import URL_RULES

    rules = dataclasses.replace(URL_RULES, rounds=4)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.id: r for r in urls.judged(df, rules).collect()}
    weight, allowed, blocked, total = Counter(), Counter(), Counter(), Counter()
    for i, url, html in pages:
        host = url.split("/")[2]
        total[host] += 1
        allowed[host] += got[i].rule in ("example.net/en/", "org/fr/")
        blocked[host] += got[i].rule in ("net/", "example.com/de/")
        for part in html.lower().split('href="')[1:]:
            other = part.split("//")[1].split("/")[0]
            weight[host, other] += host != other

    def walk(seed, back):
        score = {h: (1 - rules.follow) * seed[h] for h in hosts}
        start, out = dict(score), Counter()
        for (a, b), n in weight.items():
            out[b if back else a] += n
        for _ in range(rules.rounds):
            moved = dict(start)
            for (a, b), n in weight.items():
                a, b = (b, a) if back else (a, b)
                if n:
                    moved[b] += rules.follow * score[a] * n / out[a]
            score = moved
        return score

    t, p, d, q = walk(allowed, False), walk(total, False), walk(blocked, True), walk(total, True)
    for i, url, _ in pages:
        host = url.split("/")[2]
        assert abs(got[i].trust - t[host] / p[host]) < 1e-6 and abs(got[i].distrust - d[host] / q[host]) < 1e-6
        if got[i].rule is None:
            assert got[i].verdict == ("block" if d[host] / q[host] - t[host] / p[host] >= rules.threshold else "allow")


def test_links_alone_block_a_host(spark):
    """Hosts that link only to blocked hosts of their own size, one of many linkers, and one of very many pages."""
    from evenkeel.llm.queries import URL_RULES

    link = lambda h: f'<a href="http://{h}/">'
    pages = [(f"bad{i}.net", "") for i in range(2) for _ in range(5)] + [("good.example.org", "")] * 5
    pages += [(f"only{i}.com", link("bad0.net")) for i in range(6) for _ in range(5)] + [("large.com", link("bad1.net"))] * 50
    pages += [("mixed.com", link("good.example.org") * 3 + link("bad0.net"))] * 5 + [("own.com", link("own.com"))] * 5
    rows = [(i, f"http://{h}/fr/", html) for i, (h, html) in enumerate(pages)]
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()
    blocked = {r.host for r in got if r.verdict == "block"}
    assert {"bad0.net", "bad1.net", "large.com", *(f"only{i}.com" for i in range(6))} <= blocked
    assert not blocked & {"good.example.org", "mixed.com", "own.com"}


# Pipeline ---------------------------------------------------------------------
def test_pipeline_against_its_operators(spark):
    """Every stage's rows from the other tests' brute-force versions, stage after stage."""
    import corpus_pipeline
    from evenkeel.llm import decontaminate, pieces, quality, secrets
    from evenkeel.llm.queries import piece_model, trusted
    from tests.llm.test_text_operators import edited, slow_counts, slow_matches, slow_similar

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 250 and length(text) < 6000")
    # Copies with a few other words, on both sides of the similarity, most of them beyond four bits.
    rng, rows = random.Random(12), docs.where("length(text) > 1500").orderBy("doc_id").limit(24).collect()
    more = [r.asDict() | {"doc_id": 10**6 + k, "text": edited(rng, r.text.split(), round(len(r.text.split()) * (0.01 + k % 4 * 0.01)))} for k, r in enumerate(rows)]
    docs = spark.createDataFrame([*map(tuple, docs.collect()), *(tuple(m[c] for c in docs.columns) for m in more)], docs.schema)
    rules = quality.QualityRules()
    weights = quality.fit(docs, trusted(spark, SF), rules)
    llr = {r.row.doc_id: r.llr for r in quality.measured(docs, weights, rules).select("row", "llr").collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    counts = {i: slow_counts(t) for i, t in text.items()}
    left = {i for i in text if counts[i][0] >= 50 and 100 * counts[i][4] <= 50 * counts[i][0] and llr[i] >= rules.threshold}
    stage, names = docs, []
    for name, run in corpus_pipeline.STAGES[:4]:
        names.append(name)
        stage = run(spark, stage, SF)
        assert stage.columns == docs.columns
        if name == "SimHash near-dedup":
            order = sorted(left)
            left = {order[root] for root in slow_similar([text[i] for i in order], 5, 0.8)}
            assert any(i not in left for i in order if i >= 10**6) and any(i in left for i in order if i >= 10**6)
        if name == "benchmark decontamination":
            items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
            left = {i for i in left if not slow_matches(text[i], items, decontaminate.Decontamination())}
        stage = spark.createDataFrame(stage.collect(), stage.schema)
        assert {r.doc_id for r in stage.collect()} == left, name
    models = secrets.fit(spark.createDataFrame([(i, text[i]) for i in left], "doc_id long, text string"), secrets.SecretRules())
    masked = {i: secrets.masked(text[i], models.spans(text[i]), "[secret]") for i in left}
    assert {r.doc_id: (r.text, r.n_chars) for r in stage.collect()} == {i: (t, len(t)) for i, t in masked.items()}
    own = pieces.model(piece_model())
    last = corpus_pipeline.STAGES[4][1](spark, stage, SF).collect()
    assert {r.doc_id: (r.ids, r.text, r.n_tokens) for r in last} == {i: (own.encode([t])[0].tolist(), t, len(own.encode([t])[0])) for i, t in masked.items()}
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), SF).count() == 0
