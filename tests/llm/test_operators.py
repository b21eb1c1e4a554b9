"""Operators against brute force, and what each leaves behind."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from mixfield.llm import audio, language, lines, mixing, packing, queries, simhash, substrings, toxicity, urls, vectors

DATA = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def brute_fingerprint(text):
    import xxhash

    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(fps):
    """The smallest key that each key reaches over fingerprints at most two bits apart."""
    label = {k: k for k in fps}
    keys = sorted(fps)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2]
    for _ in keys:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not changed:
            return label
    return label


def test_near_duplicates_of_documents(spark):
    docs = table(spark, "documents")
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    found = queries.op1_simhash_near_dedup(spark, DATA).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in found} == fps
    assert {r.doc_id: r.component_id for r in found} == reachable(fps)


def test_links_in_full_and_sparse_cells(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) % (1 << 64) for b in base for _ in range(12)})
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want = reachable({x - (1 << 64) if x >> 63 else x: x for x in fps})
    for paired in (1, 8, 1000):
        monkeypatch.setattr(simhash, "PAIRED", paired)
        edges = simhash.links(nodes).collect()
        label = {x: x for x in want}
        for _ in range(len(label)):
            before = dict(label)
            for e in edges:
                assert ((e.a ^ e.b) & ((1 << 64) - 1)).bit_count() <= 2
                label[e.a] = label[e.b] = min(label[e.a], label[e.b])
            if before == label:
                break
        assert label == want


def test_tokens_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    texts = ["", " ", "a  b", " x", "x \n y", "don't stop", "tail ", "\n\nEn été, ça va.", "1,234 + 5", "a\u00a0b \x1cc", "日本語 text", "ab cd\n\nef  gh"]
    ids, counts = packing.tokenize(texts, queries.ranks_path())
    other = Tokenizer.from_file(queries.ranks_path().replace(".tiktoken", ".json")).encode_batch(texts, add_special_tokens=False)
    assert counts.tolist() == [len(x.ids) for x in other]
    assert ids.tolist() == [i for x in other for i in x.ids]


def test_added_tokens_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = ["plain text here", f"end {end} next", end, f"{end}{end}", f"a{end}b", f" {end} ", "", f"x  {end}\n\n  y z", "<|endoftext|", f"<|{end}", f"déjà vu{end}"]
    ids, counts = packing.tokenize(texts, queries.ranks_path())
    other = Tokenizer.from_file(queries.ranks_path().replace(".tiktoken", ".json")).encode_batch(texts, add_special_tokens=False)
    assert counts.tolist() == [len(x.ids) for x in other]
    assert ids.tolist() == [i for x in other for i in x.ids] and 50256 in ids


@pytest.mark.parametrize("lengths", [[1], [1023], [1024, 1024], [700, 700, 700], list(range(1, 900, 7)), [5] * 1000, []])
def test_assignment_is_whole_and_full(lengths):
    pieces = packing.assign(lengths, 1024, 1.0, 1 / 256)
    got = Counter()
    filled = Counter()
    for document, start, n, sequence, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == filled[sequence]
        filled[sequence] += n
        got[document] += n
    assert [got[i] for i in range(len(lengths))] == lengths
    assert all(n <= 1024 and n & (n - 1) == 0 for n in filled.values())


def test_packing_balances_cost():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 300) for _ in range(4000)]
    cost = Counter()
    for _, _, n, sequence, _ in packing.assign(lengths, 1024, 1.0, 1 / 256):
        cost[sequence] += n + n * n / 256
    whole = [cost[s] for s in range(sum(lengths) // 1024)]
    fitted = []  # the longest first, each into the first sequence with room
    for n in sorted(lengths, reverse=True):
        at = next((f for f in fitted if f[0] >= n), None)
        if at is None:
            fitted.append(at := [1024, 0.0])
        at[0] -= n
        at[1] += n + n * n / 256
    assert np.std(whole) < 0.5 * np.std([c for _, c in fitted])


def test_toxic_documents_are_found(spark):
    data = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op3_toxicity(spark, data).collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    toxic = [found[r.doc_id].toxic for r in labels if r.toxic]
    clean = [found[r.doc_id].toxic for r in labels if not r.toxic]
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.02


def test_ordinal_regression_shares_weights():
    rng = np.random.default_rng(1)
    rows, toxic = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append(np.unique(np.concatenate([rng.integers(100, 5000, 30), rng.integers(0, 8, 1 + i % 5) if bad else []])).astype("<u4"))
        toxic.append(int(bad))
    model = toxicity.train(rows, np.array(toxic))
    assert model.thresholds[0] < model.thresholds[1]
    assert set(range(8)) <= set(model.weights) and len(model.weights) < 20
    severity = [model.severity({x for x in r.tolist() if x in model.weights}) for r in rows]
    assert np.mean([s >= 0.5 for s, t in zip(severity, toxic) if t]) > 0.95 and np.mean([s >= 0.5 for s, t in zip(severity, toxic) if not t]) < 0.02
    two, five = (np.mean([s for i, s in enumerate(severity) if i % 4 == 0 and i % 5 == k]) for k in (1, 4))
    assert five > two


def test_ordinal_loss_is_that_of_intervals():
    rng = np.random.default_rng(2)
    score, grade, thresholds = rng.normal(size=30), rng.integers(0, 3, 30), np.array([-0.4, 0.9])

    def brute(score, thresholds):
        above = lambda x, k: 1.0 if k < 0 else 0.0 if k == 2 else 1 / (1 + np.exp(thresholds[k] - x))
        return -np.mean([np.log(above(x, g - 1) - above(x, g)) for x, g in zip(score, grade)])

    value, by_score, by_threshold = toxicity.loss(score, thresholds, grade)
    assert abs(value - brute(score, thresholds)) < 1e-12
    for slopes, which in ((by_score, 0), (by_threshold, 1)):
        for i in range(len(slopes)):
            moved = [[score.copy(), thresholds.copy()] for _ in range(2)]
            moved[0][which][i] += 1e-6
            moved[1][which][i] -= 1e-6
            assert abs((brute(*moved[0]) - brute(*moved[1])) / 2e-6 - slopes[i]) < 1e-7


def test_grades_come_from_other_documents():
    """The order among toxic documents of a fold stays the same whatever their own features teach."""
    rng = np.random.default_rng(3)
    toxic = np.array([i % 2 for i in range(200)])
    fold = np.array([i // 2 % 2 for i in range(200)])
    rows = [np.unique(np.concatenate([rng.integers(100, 3000, 20), rng.integers(0, 6, 1 + i // 4 % 4) if toxic[i] else []])).astype("<u4") for i in range(200)]
    grades = toxicity.severity_order(rows, toxic, fold)
    assert set(grades[toxic == 0]) == {0} and set(grades[toxic == 1]) == {1, 2}
    other = [np.append(r, np.uint32(7)) if toxic[i] and fold[i] == 0 and i % 8 == 1 else r for i, r in enumerate(rows)]
    changed = toxicity.severity_order(other, toxic, fold)
    assert (changed[(fold == 0)] == grades[fold == 0]).all()


def water(sizes, weights, total, cap):
    left, target, active = total, dict.fromkeys(sizes, 0.0), {s for s in sizes if sizes[s]}
    while left > 1e-9 and active:
        share = sum(weights[s] for s in active)
        for s in active:
            target[s] += left * weights[s] / share
        left = 0.0
        for s in list(active):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                active.discard(s)
    return target


def test_mix_meets_targets(spark):
    docs = table(spark, "documents").collect()
    sizes = Counter()
    for d in docs:
        sizes[d.source] += len((d.text or "").encode().split())
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    target = water(sizes, weights, 1.5 * sum(sizes.values()), 2)
    found = queries.op4_source_mixing(spark, DATA).collect()
    taken = Counter()
    for r in found:
        taken[r.doc_id] += 0
        assert abs(r.target - target[next(d.source for d in docs if d.doc_id == r.doc_id)]) < 1e-6 * r.target + 1e-9
        assert r.taken <= 2 * r["size"]
    by = Counter()
    source = {d.doc_id: d.source for d in docs}
    for r in found:
        by[source[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(by[s] - target[s]) <= 0.01 * target[s] + 2


def test_schedule_is_spread_out(spark):
    sources = spark.createDataFrame([("a", 0, 40_000, 60_000.0), ("b", 1, 40_000, 20_000.0), ("c", 2, 0, 0.0)], "source string, sid int, source_size long, target double")
    rows = mixing.schedule(sources).orderBy("slot").collect()
    owners = [r.sid for r in rows]
    assert abs(owners.count(0) / len(owners) - 0.75) < 0.002
    for a in range(0, len(owners) - 100, 100):
        assert abs(owners[a : a + 100].count(0) - 75) <= 4
    for s in (0, 1):
        assert [r["rank"] for r in rows if r.sid == s] == list(range(owners.count(s)))


def brute_repeats(docs, window=50):
    first = {}
    for d, text in sorted(docs.items()):
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), d)
    out = {}
    for d, text in docs.items():
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_shared_passages(spark, batches):
    rng = random.Random(batches)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    docs = {}
    for d in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
            passage = rng.choice(passages)
            a = rng.randrange(max(1, len(passage) - 60))
            words += passage[a : a + rng.randrange(40, 120)]
        docs[d * 3] = " ".join(words) or None
    docs[999] = docs[30]
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    found = substrings.remove_repeats(frame, batches=batches).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found} == brute_repeats(docs)


def test_runs_are_compacted(spark):
    index = substrings.Index(spark, window=5, gram=2, fan_in=1)
    text = " ".join(f"w{i}" for i in range(40))
    for d in range(3):
        batch = spark.createDataFrame([(d, text + f" own{d}")], "doc_id long, text string")
        spans = index.add(batch).collect()
        assert bool(spans) == (d > 0)
        assert len(index.runs) == (1 if d == 0 else 2)
    index.compact()
    assert len(index.runs) == 1
    blocks = index.runs[0][0]
    assert blocks.groupBy("b1", "b2").count().where("count > 1").count() == 0 and blocks.where("d = 0").count() > 0
    # a run is in buckets and sorted, so that joins neither shuffle nor sort it
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    with substrings._sorted_scans(spark):
        plan = blocks.join(blocks.select("b1", "b2", "d").withColumnRenamed("d", "e"), ["b1", "b2"])._jdf.queryExecution().toString().split("Physical Plan")[1]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    index.close()


def test_a_batch_reads_old_texts_only_for_shared_anchors(spark):
    from pyspark.sql import functions as F

    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    index = substrings.Index(spark, window=5, gram=2)
    index.add(frame((1, words("a", 50)), (2, words("b", 50))))
    # whoever reads texts of the first batch fails from now on
    index.batches[0] = index.batches[0].select("doc_id", F.raise_error(F.lit("read")).cast("string").alias("text"))
    assert index.add(frame((3, words("c", 50)), (4, words("c", 50)))).select("d").distinct().collect() == [(4,)]
    with pytest.raises(Exception, match="read"):
        index.add(frame((5, words("x", 3) + " " + words("a", 20) + " " + words("y", 3))))


def test_shared_passages_of_documents_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = {tuple(r) for r in con.sql(queries.OP5_SQL).fetchall()}
    assert {tuple(r) for r in queries.op5_substring_dedup(spark, DATA).collect()} == want


def brute_lines(docs, run):
    pos = [(d, i) for d in sorted(docs) for i in range(len(docs[d].split("\n")))]
    lines_of = {d: docs[d].split("\n") for d in docs}
    seen, gone = set(), set()
    for d, i in pos:
        block = tuple(lines_of[d][i : i + run])
        if len(block) == run:
            if block in seen:
                gone |= {(d, i + k) for k in range(run)}
            seen.add(block)
    return {d: "\n".join(x for i, x in enumerate(lines_of[d]) if (d, i) not in gone) for d in docs}


def brute_longest_runs(docs):
    """For each document the most lines in a row that also begin at another place."""
    all_lines = {d: t.split("\n") for d, t in docs.items()}
    places = [(d, i) for d, x in all_lines.items() for i in range(len(x))]
    best = dict.fromkeys(docs, 0)
    for d, i in places:
        for e, j in places:
            n = 0
            while (d, i) != (e, j) and i + n < len(all_lines[d]) and j + n < len(all_lines[e]) and all_lines[d][i + n] == all_lines[e][j + n]:
                n += 1
            best[d] = max(best[d], n)
    return best


@pytest.mark.parametrize("run", [1, 2, 3, 4, 5, 7])
def test_repeated_lines(spark, run):
    rng = random.Random(run)
    docs = {d: "\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for d in range(40)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    found = lines.deduplicate(frame, run, runs=True).collect()
    assert {r.doc_id: r.kept for r in found} == brute_lines(docs, run)
    longest = brute_longest_runs(docs)
    assert {r.doc_id: r.longest_run for r in found} == {d: n if n >= run else 0 for d, n in longest.items()}


def test_lines_of_documents_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = {tuple(r) for r in con.sql(queries.OP6_SQL).fetchall()}
    assert {tuple(r) for r in queries.op6_line_dedup(spark, DATA).collect()} == want


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(n) + len(p), n + p, v) for v, n, p in urls.RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_and_edges(spark):
    cases = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q#f", "https://example.org", "http://x.org?a/b", "http://notexample.org/en/1", "http://a.com/fr/", "http://a.com/de/1", "http://com/de/x", "ftp://É.COM/de/", "http://a.net/p\n/q?x", "http://a.b://c.org/d", "http://a.net/" + "y" * 20_000]
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)] + [(None, cases[4], "clash"), (4, cases[4], "clash")], "page_id long, url string, host string")
    found = urls.judge(frame).collect()
    assert len(found) == len(cases) + 2
    for r in found:
        if r.page_id is not None:
            host, path, rule, verdict = brute_rule(cases[r.page_id])
            assert (r.host, r.path, r["rule"]) == (host, path, rule)
            assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert urls.judge(frame.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(frame.where("page_id = 13 or page_id < 3")).collect()} == {"allow"}


def test_entropy(spark):
    from pyspark.sql import functions as F

    texts = ["", "a", "ab", "aabb", "aabc", "hello world"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", urls.entropy(F.col("t")).alias("e")).collect()
    for r in rows:
        n = Counter(r.t)
        want = -sum(k / len(r.t) * np.log2(k / len(r.t)) for k in n.values())
        assert abs(r.e - want) < 1e-9


def test_trees_on_held_out_hosts(spark):
    """Hosts of the test are in no training row, and their labels in no statistics."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = urls.lexical(pages.select("page_id", "url"))
    rule = urls.rule_of(F.col("host"), F.col("path"))
    rows = rows.withColumn("blocked", (rule["verdict"] == "block").cast("int")).where("blocked is not null")
    held = F.pmod(F.xxhash64("host"), F.lit(4)) == 0
    train, test = rows.where(~held), rows.where(held)
    known = urls.suffix_statistics(train)
    model = urls.train(urls.with_statistics(urls.sampled(train), known))
    scored = model.transform(urls.with_vector(urls.with_statistics(test.withColumn("label", F.col("blocked").cast("double")).withColumn("blocked", F.lit(None).cast("int")), known)))
    right, share, hosts, n = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")), F.avg("label"), F.countDistinct("host"), F.count("*")).first()
    auc = BinaryClassificationEvaluator().evaluate(scored)
    print(f"held-out hosts: {right:.3f} right of {n}, majority {max(share, 1 - share):.3f}, AUC {auc:.3f}, {hosts} hosts")
    assert hosts > 5 and right > max(share, 1 - share) and auc > 0.8


def test_suffix_rates_leave_out_the_own_fold(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(f"https://h{i % 7}.x.com/{i}", "x.com", i % 3 == 0 if i % 5 else None) for i in range(60)], "url string, suffix string, blocked boolean").withColumn("blocked", F.col("blocked").cast("int"))
    got = urls.with_statistics(rows, urls.suffix_statistics(rows)).withColumn("fold", urls.fold_of(F.col("url"))).collect()
    for r in got:
        others = [x.blocked for x in got if x.blocked is not None and (r.blocked is None or x.fold != r.fold)]
        assert abs(r.suffix_rate - (sum(others) + 1) / (len(others) + 2)) < 1e-12
        assert abs(r.suffix_pages - np.log(61)) < 1e-12


def test_vector_recall_and_edges(spark):
    frame = table(spark, "embeddings")
    rows = {r.vec_id: np.array(r.embedding, float) for r in frame.collect()}
    found = queries.op8_vector_search(spark, DATA).collect()
    hits = total = 0
    for q in [v for v in rows if v % 100 == 0]:
        exact = sorted((float(np.sqrt(((x - rows[q]) ** 2).sum())), v) for v, x in rows.items() if v != q)[:10]
        own = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((rows[v] - rows[q]) ** 2).sum())) < 1e-12 for _, v, s in own)
        hits += len({v for _, v in exact} & {v for _, v, _ in own})
        total += 10
    assert hits / total >= 0.9


def test_vectors_that_take_no_part(spark):
    bad = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.5]), (7, [1.0, 2.5]), (8, [1.0, 1.5]), (100, [5.0, 5.0])]
    frame = spark.createDataFrame([(*r, 1, "clash") for r in bad], "vec_id long, embedding array<float>, label int, codes string")
    found = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in vectors.search(frame).collect())
    # the row without vec_id is a candidate, and so is each of two equal rows
    assert [x for x in found if x[0] == 0] == [(0, 1, 7, 0.5), (0, 2, 7, 0.5), (0, 3, 8, 0.5), (0, 4, None, 1.0), (0, 5, 100, 5.0)]
    assert len(found) == 10
    assert vectors.search(frame.limit(0)).count() == 0


def test_vectors_with_repeated_ids_and_dimensions(spark):
    """Every row but the query's own is a candidate: other rows of its id, copies, and rows of another dimension for theirs."""
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=4).tolist()) for i in range(1, 120)] + [(100, rng.normal(size=4).tolist()), (200, rows0 := rng.normal(size=4).tolist()), (200, rows0), (7, rng.normal(size=4).tolist())]
    rows += [(400 + i, rng.normal(size=3).tolist()) for i in range(5)] + [(900 + i, rows0) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in vectors.search(frame).collect())
    want = Counter()
    for i, (q, x) in enumerate(rows):
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(y) - x) ** 2).sum())), v) for j, (v, y) in enumerate(rows) if j != i and len(y) == len(x))[:10]
            want.update((q, place, v, round(d, 9)) for place, (d, v) in enumerate(near, 1))
    assert got == want


def random_vectors(kind: str, n: int) -> list[tuple[int, list[float]]]:
    rng = np.random.default_rng(17)
    x = rng.standard_normal((n, 32))
    if kind == "directions":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "offset":
        x = 1000 + 0.1 * x
    elif kind == "groups":
        x = 5 * rng.standard_normal((60, 32))[rng.integers(0, 60, n)] + x
    elif kind == "lengths":
        x *= 10.0 ** rng.uniform(-2, 2, (n, 1))
    return [(i, v) for i, v in enumerate(x.tolist())]


@pytest.mark.parametrize("source", ["sf0.01", "sf0.1", "directions", "offset", "groups", "lengths"])
def test_vector_recall(spark, source):
    if source.startswith("sf"):
        frame = spark.read.parquet(f"/root/testdata/{source}/embeddings.parquet")
    else:
        frame = spark.createDataFrame(random_vectors(source, 10_000), "vec_id long, embedding array<double>").repartition(8)
    rows = frame.toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    found = vectors.search(frame).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = []
    for q in ids[ids % 100 == 0]:
        away = ((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(axis=1)
        away[ids == q] = np.inf
        hits.append(len(found[q] & set(ids[np.argsort(away, kind="stable")[:10]].tolist())) / 10)
    print(f"recall of {len(hits)} queries on {len(ids)} vectors: {np.mean(hits):.4f}")
    assert np.mean(hits) >= 0.9


def test_exact_search_finds_all(spark):
    frame = spark.createDataFrame(random_vectors("lengths", 3000) + [(3000 + i, [i + 1.0] * 32) for i in range(200)], "vec_id long, embedding array<double>").repartition(4)
    x = np.array([r.embedding for r in frame.orderBy("vec_id").collect()])
    # hardly anything is reranked at first, so the bounds have to find the rest
    found = vectors.search(frame, shortlist=2, exact=True).toPandas().sort_values(["query_id", "rank"])
    for q, group in found.groupby("query_id"):
        away = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        away[q] = np.inf
        assert np.allclose(group["score"], np.sort(away)[:10])


@pytest.mark.parametrize("kind", ["tight", "ties", "one"])
def test_search_misses_none_where_codes_tell_little(spark, kind):
    """Groups whose vectors differ by far less than the groups do, many equal distances, and a vector far from all: codes hardly tell the nearest from others there."""
    rng = np.random.default_rng(23)
    if kind == "tight":
        x = 100 * rng.standard_normal((3, 32))[rng.integers(0, 3, 9000)] + 0.001 * rng.standard_normal((9000, 32))
    elif kind == "ties":
        x = rng.integers(-1, 2, (9000, 9)) + 5.0
    else:
        x = np.concatenate([rng.standard_normal((2999, 8)), np.full((1, 8), 1e20)])
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(4)
    found = vectors.search(frame).toPandas().sort_values(["query_id", "rank"])
    assert len(found) == len(x) // 10
    for q, group in found.groupby("query_id"):
        away = np.sqrt(np.add.accumulate((x - x[q]) ** 2, axis=1)[:, -1])
        away[q] = np.inf
        assert group["vec_id"].tolist() == np.lexsort((np.arange(len(x)), away))[:10].tolist()


def test_work_follows_the_sample(spark):
    """Vectors in clear groups need few cells, those of all directions most."""
    needed = {}
    for kind in ("directions", "groups"):
        x = np.array([v for _, v in random_vectors(kind, 4000)], np.float32)
        needed[kind] = vectors.share_needed(x, vectors.kmeans(x, 60, 8, np.random.default_rng(1)))
    assert needed["groups"] < 0.2 < needed["directions"] <= 1


def test_beam_search_is_not_worse():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 16))
    coder = vectors.train(x, books=4, words=32)
    errors = []
    for beam in (1, 8):
        codes, norms = coder.encode(x, beam)
        assert np.allclose(norms, (coder.decode(codes) ** 2).sum(axis=1), rtol=1e-4)
        errors.append(((x - coder.decode(codes)) ** 2).sum())
    assert errors[1] <= errors[0] < (x**2).sum()
    codes, norms = coder.encode(x, 8)
    want = ((x[:5, None, :] - coder.decode(codes)[None]) ** 2).sum(axis=2) - (x[:5] ** 2).sum(axis=1)[:, None]
    assert np.allclose(coder.scores(x[:5], codes, norms), want, atol=1e-3)


def test_language_of_held_out_documents(spark):
    data = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    held = [r for r in queries.op9_language_id(spark, data).collect() if r.held_out and lang[r.doc_id]]
    assert len(held) > 100 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_ngrams_by_hand():
    grams, counts = language.ngram_counts("Ab, ab1")  # _ab_ab_
    found = dict(zip(grams.tolist(), counts.tolist(), strict=True))
    a, b = ord("a"), ord("b")
    # "_a" has the code of "a", and "_ab" that of "ab": a separator in front is code 0
    assert found == {a: 4, b: 2, (a << 21) | b: 4, b << 21: 2, (a << 42) | (b << 21): 2}


def test_g711_tables():
    mu, a = audio.mu_law_table(), audio.a_law_table()
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def test_adpcm_follows_a_tone():
    t = np.arange(2 * (audio.BLOCK - 4) + 1)
    tone = np.stack([8000 * np.sin(t / 20), 12000 * np.sin(t / 35 + 1)]).astype(np.int16)
    blocks = audio.encode_adpcm(tone)
    assert blocks.shape == (2, audio.BLOCK)
    back = audio.decode_adpcm(blocks)
    assert np.abs(back[:, 50:].astype(int) - tone[:, 50:]).mean() < 300
    media = audio.wav(blocks.tobytes(), audio.IMA_ADPCM, block=audio.BLOCK)
    rate, samples = audio.samples_of(media)
    assert rate == 8000 and np.array_equal(samples, back.ravel())
    one_by_one = np.concatenate([audio.decode_adpcm(b[None]) for b in blocks])
    assert np.array_equal(back, one_by_one)


def test_wav_round_trip_and_resampling():
    data = bytes(range(256)) + b"x"
    for kind in (audio.MU_LAW, audio.A_LAW):
        assert audio.read_wav(audio.wav(data, kind))[0] == kind and audio.read_wav(audio.wav(data, kind))[3] == data
    assert audio.resample(np.array([0, 10, -10], np.int16)).tolist() == [0, 5, 10, 0, -10, -10]
    with pytest.raises(ValueError):
        audio.read_wav(b"RIFFxxxx")
