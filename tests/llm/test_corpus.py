"""Operators on the corpus as a whole: near-duplicates, mixing, packing, fingerprints, hosts, the pipeline."""

import hashlib
import random
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stripeworks.llm import hosts, merkle, mixing, packing, quality_rules, simhash


def test_simhash_matches_brute_force(docs, rows):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).withColumn("hex", simhash.hex_fingerprint("fp")).collect()}
    fps = [brute.simhash(t) for _, t, *_ in rows]
    want = brute.components([r[0] for r in rows], fps)
    assert len(set(want.values())) < len(want)
    for (i, *_), fp in zip(rows, fps):
        assert got[i].hex == f"{fp:016x}"
        assert got[i].component_id == want[i]


def test_chains_cover_every_near_pair():
    """Any two fingerprints within the distance share a key under which their chain keeps its budgets."""
    for a in range(64):
        for b in range(a, 64):
            d = np.array([(1 << a) | (1 << b)], np.uint64)
            assert any(not int(d[0]) & simhash.key_mask(k) and simhash.within_chain(d, simhash.KEYS[k][0])[0] for k in range(len(simhash.KEYS)))
    assert not simhash.within_chain(np.array([0b111], np.uint64), 1)[0]


@pytest.mark.parametrize("up_to", [0, 10_000])
def test_dense_links_match_brute_force(spark, monkeypatch, up_to):
    """Neighbourhoods of a few fingerprints, by lookup and by all pairs."""
    rng = random.Random(5)
    fps = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    for k in range(len(simhash.KEYS)):
        run = defaultdict(list)
        for f in fps:
            run[f & simhash.key_mask(k)].append(f)
        monkeypatch.setattr(simhash, "ALL_PAIRS_UP_TO", up_to)
        for own in run.values():
            start = simhash.KEYS[k][0]
            got = simhash._forest(np.array(own, np.uint64), start, ((1 << 64) - 1) ^ simhash.key_mask(k))
            want = [(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if simhash.within_chain(np.array([own[i] ^ own[j]], np.uint64), start)[0]]
            assert _parts(len(own), got) == _parts(len(own), want)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "rep long, fp long")
    edges = [(r.u, r.v) for r in simhash.links(df).collect()]
    want = brute.components(list(range(len(fps))), fps)
    assert _parts(len(fps), edges) == _parts(len(fps), list(want.items()))


def _parts(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_targets_are_filled_by_weight():
    t = mixing.targets([("a", 100), ("b", 100), ("c", 100), (None, 100)])
    assert t == {"a": 200.0, None: 200.0, "b": pytest.approx(400 / 3), "c": pytest.approx(200 / 3)}, "a and null stop at twice their size, b and c share the rest two to one"
    assert sum(t.values()) == pytest.approx(600)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_mixing_takes_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "c", "d", None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(brute.words(t))
    goal = mixing.targets(list(sizes.items()))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r["__src"]] and r.target == pytest.approx(goal[r["__src"]])
        assert 0 <= r.copies <= 2
        taken[r["__src"]] += r["size"] * r.copies
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 60
    again = mixing.mix(df.repartition(7)).collect()
    assert {(r["__id"], r.copies) for r in got} == {(r["__id"], r.copies) for r in again}


def test_systematic_sampling_against_prefix_sums(spark):
    """Copies are what the shifted prefix sum gains in whole numbers, document by document."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 9), "s" if i % 3 else "t") for i in range(300)], "doc_id long, text string, source string")
    by = defaultdict(list)
    for r in mixing.mix(df).collect():
        by[r["__src"]].append(r)
    for group in by.values():
        group.sort(key=lambda r: r["__rank"])
        assert [r["__rank"] for r in group] == list(range(len(group)))
        rate = group[0].target / group[0].source_size
        fits = []
        for u in mixing.offsets():
            total, want = u, []
            for _ in group:
                want.append(int(np.floor(total + rate) - np.floor(total)))
                total += rate
            fits.append(sum(a != r.copies for a, r in zip(want, group)))
        assert min(fits) <= 1, "one offset explains all, but for rounding"


def test_emit_repeats_rows(spark, odd):
    plan = mixing.mix(odd)
    want = sum(r.copies for r in plan.collect())
    got = mixing.emit(odd)
    assert got.columns == odd.columns and got.count() == want


def test_packing_is_a_partition_of_all_ids(docs, rows):
    path = packing.vocabulary_path()
    got = packing.pack(docs, capacity=256).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t, *_ in rows:
        ids = [*packing.token_ids(path, t), 0]
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == brute.crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        end = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 256
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.05 * total / 256 + 1


def test_ids_are_those_of_tokenizers(rows):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    t = Tokenizer.from_file(path)
    for text in [r[1] or "" for r in rows] + ["a<|endoftext|>b", "日本語 🙂 naïve", "don't  stop \n\n x", "1234567 <html>"]:
        assert packing.token_ids(path, text) == t.encode(text, add_special_tokens=False).ids


def test_pieces_carry_ids(spark):
    df = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    r = packing.pack(df, capacity=2, with_ids=True).orderBy("start").collect()
    ids = np.concatenate([np.frombuffer(x["ids"], "<u4") for x in r]).tolist()
    assert ids == [*packing.token_ids(packing.vocabulary_path(), "some words here"), 0]


def test_shortest_pack_first():
    rng = random.Random(1)
    h = {n: rng.randint(1, 50) for n in rng.sample(range(1, 1025), 300)}
    packs = packing.shortest_pack_first(h)
    used = defaultdict(int)
    for pattern, n in packs:
        assert sum(pattern) <= 1024 and list(pattern) == sorted(pattern, reverse=True)
        for length in pattern:
            used[length] += n
    assert used == h
    assert packing.shortest_pack_first({}) == [] and packing.shortest_pack_first({400: 5}) == [((400, 400), 2), ((400,), 1)]


def _merkle(t):
    """The written tree, from its description."""
    import re

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    secs = []
    for s in (t or "").split("\n\n"):
        pars = [(md5(p), ",".join(md5(x)[:6] for x in re.sub("([^acf-rt-z] |[。！？、，；：])", "\\1\x1f", p).split("\x1f"))) for p in s.split("\n")]
        secs.append((md5("".join(h for h, _ in pars)), "|".join(f"{h[:12]}={b}" for h, b in pars)))
    return hashlib.sha256("".join(h for h, _ in secs).encode()).hexdigest()[:32] + " " + ";".join(f"{h[:16]}:{b}" for h, b in secs)


def _near(a, b):
    """Sections, then paragraphs of what is left, then phrases, as sets."""
    if a[:32] == b[:32]:
        return 1.0
    shared, x, y = 0, *(set(f[33:].split(";")) for f in (a, b))
    for mark, between in ((":", "|"), ("=", ",")):
        shared += sum(n.count(",") + n.count("|") + 1 for n in x & y)
        x, y = ({p for n in own - other for p in n.split(mark, 1)[1].split(between)} for own, other in ((x, y), (y, x)))
    shared += len(x & y)
    return round(2 * shared / (2 * shared + len(x - y) + len(y - x)), 6)


def test_merkle_matches_brute_force(docs, rows):
    got = {r.doc_id: r for r in merkle.compare_edits(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == _merkle(t) and r.edited_fingerprint == _merkle(edited)
        assert r.near_edited == _near(_merkle(t), _merkle(edited)) and r.near_next == _near(_merkle(t), _merkle(nxt))


def test_merkle_locates_edits(spark):
    a = "one two\nthree four\n\nfive six\nseven"
    b = "one two\nthree 4\n\nfive six\nseven\n\nnew"
    four = "\n".join("pqrs")
    df = spark.createDataFrame([(a, b), (a, a), (four, "top\n" + four), ("x\n\ny\nz", "y\nz\n\nx")], "a string, b string")
    d = df.select(merkle.differing_branches(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("d")).collect()
    got = [sorted(tuple(x) for x in r.d) for r in d]
    assert got == [[("a", 0, 1), ("b", 0, 1), ("b", 2, None)], [], [("b", 0, 0)], []], "an insertion is one branch, a move none"


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_next_rows_over_ranges(spark, parts):
    """Successors by id, then hash, null ids last, and round to the first: in one range or many."""
    rng = random.Random(parts)
    rows = [(rng.choice([None, rng.randrange(-50, 50), 7, 2**62]), hashlib.md5(str(i).encode()).hexdigest()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, th string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    got = merkle.with_next(df, "id", ["th"], "th", parts).collect()
    assert len(got) == 200 and {r.th: r.next_th for r in got} == want


def test_lone_and_tied_documents(spark):
    one = merkle.compare_edits(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    tied = merkle.compare_edits(spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "z"), (2, "w")], "doc_id long, text string"))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in tied.collect()) == [(False, 1), (False, 1), (False, 2), (True, 0)]


URLS = [
    "http://WWW.Example.org/es/1?x", "https://example.org/en/12", "http://a.example.org/en/2#top", "http://b.com/fr/", "http://b.com/de/7", "http://b.com/en/7", "https://notexample.org", "nothing", None, "",
    "ftp://host.net?q=1/2", "http://x.net#/de/", "mailto://ORG/", "http://evil.com/de", "http://10.0.0.1/a", "http://shop.co.uk/a",
]


def test_hosts_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good boolean")
    got = {r.page_id: r for r in hosts.judge_urls(pages, none).collect()}
    for i, u in enumerate(URLS):
        host, path = brute.parse_url(u)
        assert (got[i].host, got[i].path) == (host, path)
        fits = [(len(h + p), said, h + p) for said, h, p in hosts.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            assert (got[i].verdict, got[i].rule) == max(fits)[1:]
        else:
            assert got[i].rule is None and got[i].verdict in ("allow", "block")


def test_reputation_shrinks_towards_the_domain(spark):
    pages, outcomes, n = [], [], 0
    for host, good, bad in (("a.good.net", 40, 2), ("b.good.net", 30, 1), ("new.good.net", 0, 0), ("a.bad.net", 2, 40), ("new.bad.net", 0, 0), ("b.bad.net", 1, 30)):
        for k in range(max(1, good + bad)):
            pages.append((n, f"http://{host}/p/{k}"))
            if good + bad:
                outcomes.append((n, k < good))
            n += 1
    p, o = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good boolean")
    r = {x.host: x for x in hosts.reputation(p, o).collect()}
    assert r["a.good.net"].n_labelled == 42 and r["a.good.net"].n_good == 40
    assert r["a.good.net"].bound > 0.8 and r["new.good.net"].n_labelled == 0 and r["new.good.net"].rate > 0.8
    assert r["new.bad.net"].rate < 0.2 and r["a.bad.net"].bound < 0.1
    verdicts = {x.host: x.verdict for x in hosts.judge_urls(p, o).collect()}
    assert verdicts["a.good.net"] == "allow" and verdicts["new.bad.net"] == "block"


def _judged(spark, counts):
    pages, outcomes, n = [], [], 0
    for host, good, bad in counts:
        for k in range(max(1, good + bad)):
            pages.append((n, f"http://{host}/p/{k}"))
            if good + bad:
                outcomes.append((n, k < good))
            n += 1
    p, o = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good boolean")
    return {x.host: x for x in hosts.judge_urls(p, o).select("host", "rate", "bound", "verdict").distinct().collect()}


def test_few_labels_give_a_wide_bound(spark):
    alone = _judged(spark, [(f"h{i}.org{i}.net", 3, 0) if i % 2 else (f"h{i}.org{i}.net", 0, 3) for i in range(40)])
    assert alone["h1.org1.net"].rate - alone["h1.org1.net"].bound > 0.2, "labels of a domain's only host are not counted again"
    mixed = _judged(spark, [("few.a.net", 2, 1), ("many.a.net", 200, 100), ("b.a.net", 20, 10), ("c.b.net", 6, 3), ("none.c.net", 0, 0)])
    gap = {h: r.rate - r.bound for h, r in mixed.items()}
    assert gap["few.a.net"] > 2 * gap["many.a.net"] and gap["none.c.net"] > gap["few.a.net"]
    good = _judged(spark, [("many.a.net", 80, 20), ("b.a.net", 78, 22), ("c.b.net", 81, 19), ("none.c.com", 0, 0)])
    assert good["many.a.net"].verdict == "allow" and good["none.c.com"].verdict == "block" and good["none.c.com"].rate > 0.6, "for lack of evidence alone"


def test_reputation_of_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert hosts.judge_urls(pages, spark.createDataFrame([], "page_id long, good boolean")).collect() == []


def test_domains(spark):
    df = spark.createDataFrame([(h,) for h in ("a.b.example.com", "shop.co.uk", "x.shop.co.uk", "localhost", "10.0.0.1", "", "com")], "h string")
    d = hosts.registered_domain(F.col("h"))
    got = [tuple(r) for r in df.select(d, hosts.suffix_of(d)).collect()]
    assert got == [("example.com", "com"), ("shop.co.uk", "co.uk"), ("shop.co.uk", "co.uk"), ("localhost", "localhost"), ("10.0.0.1", "10.0.0.1"), ("", ""), ("com", "com")]


def test_no_python_on_the_native_paths(docs, spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good boolean")
    for df in (merkle.compare_edits(docs), hosts.judge_urls(pages, none)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Pandas" not in plan and "Python" not in plan and "CartesianProduct" not in plan


def test_odd_rows(odd, none):
    n = odd.count()
    near = simhash.near_duplicates(odd).collect()
    assert len(near) == n
    assert {r.component_id for r in near if r.doc_id in (5, 6, 7)} <= {5, 7}
    assert len(mixing.mix(odd).collect()) == n
    assert len(merkle.compare_edits(odd).collect()) == n
    packed = packing.pack(odd).collect()
    assert sum(r.start == 0 for r in packed) == n and {r.doc_id for r in packed} == {r.doc_id for r in odd.collect()}
    for df in (simhash.near_duplicates(none), mixing.mix(none), mixing.emit(none), merkle.compare_edits(none), packing.pack(none)):
        assert df.collect() == []
    pages = odd.selectExpr("doc_id as page_id", "text as url", "score as rate", "kept as host")
    assert len(hosts.judge_urls(pages, pages.selectExpr("page_id", "true as good").limit(0)).collect()) == n


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = ["the", "of", "and", "to", "in", "was"] * 6 + ["".join(rng.choice("abdeghilmnoprst") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    rows = []
    for i in range(90):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 25))) for _ in range(rng.randint(2, 6))]
        if i % 3 == 0:
            lines.append("All rights reserved.")
        t = "\n".join(lines) if i % 9 else "BUY NOW!! " * 40
        if i % 10 == 7:
            t = rows[-1][1]
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {r.doc_id for r in quality_rules.judge(spark.createDataFrame(rows, schema)).filter("kept").collect()}
    docs = [r for r in rows if r[0] in kept]
    assert all(i % 9 for i in kept) and len(docs) > 60
    docs = [(r[0], t, *r[2:]) for r, (t, _, _) in zip(docs, brute.line_dedup([r[1] for r in docs], 10))]
    comp = brute.components([r[0] for r in docs], [brute.simhash(r[1]) for r in docs])
    docs = [r for r in docs if comp[r[0]] == r[0]]
    path = packing.vocabulary_path()
    plan = {r["__id"]: r.copies for r in mixing.mix(spark.createDataFrame(docs, schema)).collect()}
    want = sorted((i, len(packing.token_ids(path, t)) + 1) for i, t, *_ in docs for _ in range(plan[i]))
    assert sorted((r.doc_id, r.doc_tokens) for r in packed if r.start == 0) == want
    assert sum(r.length for r in packed) == sum(n for _, n in want)


def test_stages_keep_the_columns(spark, docs, none):
    for d in (docs, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, "")
            assert d.columns == docs.columns
            d.collect()



def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(4, long, "en", "a", 1), (4, long, "en", "b", 1), (2, long + " end", "en", "a", 1), (9, "something else altogether here", "en", None, 1), (9, "something else altogether here", "en", None, 1), (None, "no id", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = simhash.near_duplicates(docs).collect()
    assert {r.component_id for r in near if r.doc_id in (2, 4)} == {2}
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 2, 9] and kept[0].asDict().keys() == set(docs.columns)


def test_near_duplicate_stage_keeps_groups_without_ids(spark):
    one, other = (" ".join(f"{p}{i}" for i in range(40)) for p in "pq")
    rows = [(None, one, None, None, 1), (None, one, "en", None, 1), (None, one + " more", None, "a", 1), (3, other, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 3]


def test_emit_splits_equal_rows(spark):
    """Rows that agree in id, source and text get all their copies between them, none more than one above another."""
    docs = spark.range(700).selectExpr("cast(null as long) as doc_id", "'some words of one text' as text", "'a' as source", "id as tag")
    plan = mixing.mix(docs)
    n = plan.agg(F.sum("copies")).first()[0]
    got = mixing.emit(docs).groupBy("tag").count().collect()
    assert sum(r["count"] for r in got) == n and {r["count"] for r in got} <= {1, 2} and len(got) == 700


def _jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def _edited(rng, base, n):
    t = list(base)
    for at in rng.sample(range(len(t)), n):
        t[at] = f"x{rng.randrange(10**6)}"
    return " ".join(t)


def test_near_duplicate_stage_catches_near_copies(spark):
    """Copies with a few words changed go whatever their fingerprints' distance; pairs under 0.8 stay."""
    rng = random.Random(4)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(4):
            rows.append((len(rows), _edited(rng, base, rng.choice([1, 2, 3, 9]))))
    near = [(i, j) for i, a in rows for j, b in rows if i < j and _jaccard(a, b) >= 0.8]
    part = _parts(len(rows), near)
    far = [bin(brute.simhash(rows[i][1]) ^ brute.simhash(rows[j][1])).count("1") for i, j in near]
    assert max(far) > 2 and 30 < len(set(part)) < len(rows)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == set(part)


def test_crowded_buckets(spark, monkeypatch):
    """An original's many copies go by its star; of texts that only resemble it, near pairs are found by their rarest shingles."""
    from stripeworks.llm import near_copies

    monkeypatch.setattr(near_copies, "ALL_PAIRS_UP_TO", 8)
    monkeypatch.setattr(near_copies, "RARE_PAIRS_UP_TO", 8)
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(250)]
    texts = [" ".join(base)] + [_edited(rng, base, 4) for _ in range(60)]
    for _ in range(30):  # pairs of texts unlike the original and all others
        t = _edited(rng, base, 11)
        texts += [t, t + " and more"]
    texts += [t + " of those" for t in [_edited(rng, base, 12)] * 1] + [_edited(rng, base, 11) + f" end{i}" for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.i: r.f for r in near_copies.groups(docs).join(docs.select(F.col("doc_id").alias("i"), near_copies.text_hash().alias("v")), "v").select("i", F.col("first.id").alias("f")).collect()}
    near = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and _jaccard(a, b) >= 0.8]
    part = _parts(len(texts), near)
    assert {part[i] for i in range(61)} == {0} and len(set(part)) > 40
    assert all(part[i] == part[got[i]] for i in got), "nothing is linked by chance"
    assert [got[i] for i in range(61)] == [0] * 61
    assert all(got[61 + 2 * k] == got[62 + 2 * k] for k in range(30))


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """A text that hangs on a copy of a head, not on the head, is in its group; so is what only a crowded shingle or no band brings together."""
    from stripeworks.llm import near_copies

    monkeypatch.setattr(near_copies, "ALL_PAIRS_UP_TO", 4)
    monkeypatch.setattr(near_copies, "HEADS", 1)
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [" ".join(base)] + [_edited(rng, base, 2) for _ in range(40)]
    for _ in range(25):  # chains that lead away from the original
        near = _edited(rng, base, 3)
        texts += [near, _edited(rng, near.split(), 3)]
    texts += [_edited(rng, base, 7) for _ in range(40)] + ["", " ", "a", "A", "a b c d e f", "a b c d e f g"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, texts[at]) for i, at in enumerate(order)], "doc_id long, text string")
    near = [(i, j) for i, a in enumerate(order) for j, b in enumerate(order) if i < j and _jaccard(texts[a].lower(), texts[b].lower()) >= 0.8]
    part = _parts(len(texts), near)
    for bands, up_to in ((True, 64), (False, 2)):
        monkeypatch.setattr(near_copies, "RARE_PAIRS_UP_TO", up_to)
        if not bands:  # each text has bands and a fingerprint of its own: all rests on the filed shingles
            monkeypatch.setattr(near_copies, "bands", lambda s: [int(x) for x in s.view(np.int64)[-1:]])
        groups = near_copies.groups(docs).join(docs.select(F.col("doc_id").alias("i"), near_copies.text_hash().alias("v")), "v")
        assert {r.i: r.f for r in groups.select("i", F.col("first.id").alias("f")).collect()} == dict(enumerate(part)), (bands, up_to)


def test_keys_of_near_copies(spark):
    """Bands meet as often as independent rows would."""
    from stripeworks.llm import near_copies

    rng = np.random.default_rng(3)
    met = []
    for _ in range(300):
        own = rng.integers(1 << 63, size=200, dtype=np.uint64)
        other = np.concatenate((own[22:], rng.integers(1 << 63, size=22, dtype=np.uint64)))  # 178 of 222: a similarity of 0.80
        met.append(sum(a == b for a, b in zip(near_copies.bands(np.sort(own)), near_copies.bands(np.sort(other)))))
    assert 0.28 < np.mean(met) / near_copies.BANDS < 0.38 and np.mean(np.array(met) == 0) < 0.02
    assert near_copies.shingles(None).size == 0 and near_copies.shingles("a b").size == 1
    assert near_copies.shingles("A b c d e f").tolist() == near_copies.shingles("a  b\nc d e F").tolist() and near_copies.shingles("a b c d e f").size == 2


def test_mixing_takes_any_number_of_sources(spark):
    n = 200_010
    docs = spark.range(n).selectExpr("id as doc_id", "repeat('w ', cast(id % 7 as int)) as text", "if(id = 5, null, concat('s', id)) as source")
    goal = mixing.targets([(None if i == 5 else f"s{i}", i % 7) for i in range(n)])
    got = mixing.mix(docs).select("__src", "target").collect()
    assert len(got) == n and all(r.target == pytest.approx(goal[r["__src"]]) for r in got)


def test_near_duplicate_stage_tells_rows_apart_by_text(spark):
    """Different texts of one id all stay; a text without an id links those on either side of it."""
    w = [f"w{i}" for i in range(300)]
    a, b = w, [f"x{i}" for i in range(25)] + w[25:]
    c = b[:-25] + [f"y{i}" for i in range(25)]
    one, other = (" ".join(f"{p}{i}" for i in range(40)) for p in "pq")
    rows = [(1, one), (1, other), (5, " ".join(a)), (None, " ".join(b)), (6, " ".join(c))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, one), (1, other), (5, " ".join(a))])


def test_filters_miss_no_key(spark):
    from stripeworks.llm.common import bits_of, with_bit

    rows = spark.range(40_000).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("id"), F.md5((F.col("id") % 30_000).cast("string")).alias("v"))
    keys = rows.filter(F.xxhash64("v") % 10 == 0)
    got = with_bit(rows, bits_of(keys.select(F.col("v").alias("kv"), F.col("id").alias("ki")), "kv", "ki"), "v", "id")
    n, lost, chance = got.select(F.xxhash64("v") % 10 == 0, "__bit").toDF("key", "hit").agg(F.count("*"), F.count(F.when(F.expr("key and not hit"), 1)), F.count(F.when(F.expr("hit and not key"), 1))).first()
    assert n == 40_000 and lost == 0 and chance < 60
    assert with_bit(rows, bits_of(keys.limit(0), "v", "id"), "v", "id").filter("__bit").isEmpty()


def _shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    store.listenerBus().waitUntilEmpty(30_000)
    stages = store.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_near_duplicate_stage_moves_few_texts(spark, tmp_path):
    """Texts that have no near copy are neither shuffled nor left on disk."""
    import os
    import random
    import string

    rng = random.Random(11)
    texts = [" ".join("".join(rng.choices(string.ascii_letters + string.digits, k=200)) for _ in range(100)) for _ in range(150)]
    texts += [t + " end" for t in texts[:6]] + texts[6:9]
    total = sum(map(len, texts))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(20, texts[20], "de", "s", 1), (None, texts[21], "en", "s", 2), (None, "no id", "en", "s", 3), (None, "no id", "de", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "in"))
    shared = spark.conf.get("spark.checkpoint.dir")
    on_disk = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(shared.removeprefix("file:")) for f in names)
    before, held = _shuffled(spark), on_disk()
    corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "in")), "").write.parquet(str(tmp_path / "out"))
    assert _shuffled(spark) - before < 0.7 * total and on_disk() - held < 0.3 * total
    kept = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.lang) for r in kept) == [(False, i, "de" if i == 20 else "en") for i in range(150)] + [(True, None, "de")]
