"""Every operator against brute force, exact round trips or held-out accuracy."""

import hashlib
import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import __spark_entry__ as entry
from labeltext.llm import (
    bpe, chat, chunks, common, exact, fingerprint, packing, quality, queries, simhash, toxicity, url_rules,
)

PATH = queries.vocabulary_path()
SCHEMA = "doc_id long, text string, fp string, piece string, _order int, score double, label string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def words(rng, n):
    return " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    base = words(rng, 120)
    return [
        (1, base), (2, base.upper()), (3, base), (3, base), (4, None), (5, ""), (6, " \n\t "), (None, "no id"),
        (None, None), (7, base.replace(base.split()[50], "changed", 1)), (8, "<|endoftext|>a<|endoftext|>"),
        (9, "日本語 тест 🎉🎉 naïve don't 1234 ²³"), (10, words(rng, 30_000)), (11, "x" * 40_000), (12, "one two"),
        (13, words(rng, 20) + "\n" + base), (14, "ÀÉ " + base),
    ]


@pytest.fixture(scope="module")
def odd(spark, odd_texts):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    rows = [(i, t, "f", "p", 7, 0.5, "l") for i, t in odd_texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def run(name, spark, folder):
    return queries.QUERIES[name](spark, folder)


def table(spark, small, name="documents"):
    return spark.read.parquet(f"{small}/{name}.parquet")


# Byte-level BPE


def test_bpe_is_the_library_on_all_code_points(library):
    coder, by_library = (bpe.encoder(open(PATH, "rb").read(), how) for how in (False, True))
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b 1{chr(c)} {chr(c)}'s " for c in points[i : i + 40]) for i in range(0, len(points), 40)]
    texts += ["", "  \n\n x", " " * 50, "a" * 3000, "it's I'LL <|endoftext|>", "<|endoftext|>" * 3]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for one in (coder, by_library):
        ids, at = one.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want


def test_bpe_query(spark, small, library):
    got = {r.doc_id: r for r in run("op2_bpe", spark, small).collect()}
    for r in table(spark, small).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        row = got[r.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(spark, odd, none, library):
    rows = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert bpe.decode(bpe.encode(none, PATH), PATH).count() == 0
    broken = spark.createDataFrame([(1, [200, 99999, -1, None, 0]), (2, None), (3, [])], "doc_id long, ids array<int>")
    texts = {r.doc_id: r.text for r in bpe.decode(broken, PATH).collect()}
    assert texts == {1: library.decode([200, 0]), 2: "", 3: ""}


# Packing


def lay_out(rows, capacity):
    """Sequences as lists of (offset, length), checked to be gapless."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= capacity
    return by


def test_packing_query(spark, small, library):
    rows = run("op1_pattern_packing", spark, small).collect()
    by = lay_out(rows, 2048)
    pieces = {(r.doc_id, r.piece): r for r in rows}
    assert len(pieces) == len(rows)
    total = 0
    for r in table(spark, small).collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        own = [p for (d, _), p in sorted(pieces.items()) if d == r.doc_id]
        assert sum(p.length for p in own) == len(ids) and all(p.length == 2048 for p in own[1:])
        for p in own:
            part = np.array(ids[p.start : p.start + p.length], "<u4")
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
    assert len(by) <= -(-total // 2048) * 1.02 + 1


def test_packing_odd_rows(odd, none):
    rows = queries.packed(odd, 64).collect()
    lay_out(rows, 64)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in odd.collect())
    assert queries.packed(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_the_histogram_exactly(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(129, np.int64)
    np.add.at(histogram, np.minimum(128, 1 + rng.exponential(30, 10 ** (seed % 4 + 1)).astype(int)), 1)
    if seed == 5:
        histogram[:] = 0
        histogram[10] = 1000  # one length only, no exact pattern
    seen = np.zeros(129, np.int64)
    plan = packing.plan(histogram)
    for pattern, times in plan:
        assert sum(pattern) <= 128 and times > 0
        np.add.at(seen, list(pattern), times)
    assert (seen == histogram).all()
    fewest = max(-(-(histogram * np.arange(129)).sum() // 128), histogram[65:].sum())
    assert sum(t for _, t in plan) <= fewest * 1.1 + 2


# SimHash


def brute_simhash(rows):
    prints = []
    for _, text in rows:
        found = (text or "").encode().lower().split()
        grams = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
        hashes = [xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group, strict=True):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return Counter((d, f"{p:016x}", least.get(g)) for (d, _), p, g in zip(rows, prints, group, strict=True))


def test_simhash_query(spark, small):
    rows = [(r.doc_id, r.text) for r in table(spark, small).collect()]
    assert Counter(map(tuple, run("op3_simhash", spark, small).collect())) == brute_simhash(rows)


def test_simhash_odd_rows(odd, none, odd_texts):
    got = simhash.near_duplicates(odd).withColumn("fp", simhash.hex_digits(F.col("fp")))
    assert Counter(map(tuple, got.collect())) == brute_simhash(odd_texts)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("most", [64, 4096])
def test_simhash_links_lose_nothing(spark, most):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**64, 3, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64) for _ in range(3)]
    prints = np.unique(np.concatenate([centre[rng.integers(0, 3, 150)] ^ flips[0] ^ flips[1] ^ flips[2], rng.integers(0, 2**64, 60, dtype=np.uint64)]))
    i, j = np.triu_indices(len(prints), 1)
    near = np.bitwise_count(prints[i] ^ prints[j]) <= 3
    want = common.joined(np.arange(len(prints)), i[near], j[near])
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in common.components(simhash.links(frame, 3, most)).collect()}
    groups = defaultdict(set)
    for p, w in zip(prints.view(np.int64).tolist(), want, strict=True):
        groups[w].add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1200)}


# Substring dedup


def test_chunks_find_every_passage_of_54_words():
    rng = random.Random(5)
    for _ in range(40):
        passage = words(rng, 54)
        pair = [f"{words(rng, 30)} {passage} {words(rng, 9)}", f"{words(rng, rng.randint(0, 40))}\n{passage}\n{words(rng, 20)}"]
        found = chunks.chunked(*common.text_bytes(pa.array(pair)))
        digests = list(map(tuple, found.digest.tolist()))
        first = {d for d, t in zip(digests, found.text, strict=True) if t == 0}
        shared = np.array([t == 1 and d in first for d, t in zip(digests, found.text, strict=True)])
        row, start, end = chunks.cut_runs(found, shared, chunks.LEAST_WORDS)
        assert row.tolist() == [1]
        raw = pair[0].encode() + pair[1].encode()
        assert raw[start[0] : end[0]].decode().strip() in passage


def test_chunks_find_every_passage_of_51_words_of_one_letter():
    rng = random.Random(15)
    for _ in range(1000):
        passage, *around = (" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (51, 30, 30, 30, 30))
        pair = [f"{around[0]} {passage} {around[1]}", f"{around[2]} {passage} {around[3]}"]
        found = chunks.chunked(*common.text_bytes(pa.array(pair)))
        digests = list(map(tuple, found.digest.tolist()))
        first = {d for d, t in zip(digests, found.text, strict=True) if t == 0}
        shared = np.array([t == 1 and d in first for d, t in zip(digests, found.text, strict=True)])
        assert 1 in chunks.cut_runs(found, shared, chunks.LEAST_WORDS)[0]


def test_substring_dedup_keeps_one_and_leaves_others(spark):
    rng = random.Random(6)
    passage, phrase = words(rng, 60), words(rng, 8)
    clean = [f"{words(rng, 80)} {phrase} {words(rng, 80)}" for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(clean)]
    holders = [(10 + i, f"{words(rng, 15)} {passage} {words(rng, 15)}") for i in range(5)]
    twice = [(30, f"{words(rng, 15)} {phrase} {words(rng, 30)}")]
    cut, spans = chunks.deduplicated(spark.createDataFrame(rows + holders + twice, "doc_id long, text string"))
    got = {r.doc_id: r for r in cut.collect()}
    for i, text in [*rows, *twice, holders[0]]:
        assert got[i].text == text and got[i][spans] == []
    for i, text in holders[1:]:
        kept, at = [], 0
        for a, b in got[i][spans]:
            kept.append(text[at:a])
            at = b
        assert "".join(kept) + text[at:] == got[i].text
        assert sum(b - a for a, b in got[i][spans]) > 100 and passage not in got[i].text
        assert got[i].text.split()[:15] == text.split()[:15]


def test_substring_dedup_odd_rows(odd, none, odd_texts):
    cut, spans = chunks.deduplicated(odd)
    rows = cut.collect()
    assert cut.columns == [*odd.columns, spans] and len(rows) == len(odd_texts)
    texts = defaultdict(set)
    for r in rows:
        texts[r.doc_id].add(r.text)
        assert r.fp == "f" and r["_order"] == 7
    assert texts[1] == {odd_texts[0][1]} and len(texts[3]) == 1 and len(texts[3].pop()) < 20
    assert texts[None] == {"no id", None} and texts[4] == {None} and texts[5] == {""}
    assert chunks.deduplicated(none)[0].count() == 0


# URL rules


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
    path_end = min([len(rest), *(rest.find(c, end) for c in "?#" if rest.find(c, end) >= 0)])
    host = "".join(c.lower() if c in string.ascii_uppercase else c for c in rest[:end])
    path = rest[end:path_end]
    fit = [r for r in queries.URL_RULES if (h := r.split()[1].partition("/"))[0] == host or host.endswith("." + h[0])]
    fit = [r for r in fit if path.startswith("/" + r.split()[1].partition("/")[2])]
    best = max(fit, key=lambda r: len(r.split()[1]), default=None)
    return host, path, best


ODD_URLS = [
    None, "", "no scheme/en/", "http://", "http://COM/", "https://www.EXAMPLE.com/en/x?y#z", "http://xcom/", "http://a.com",
    "http://example.com/EN/", "ftp://a.net/es/1?a=1&b=2", "http://a.net/es?/fr/", "http://É.com/ü", "http://a://b.com/en/",
    "http://a.com:80/x", "http://" + "a." * 3000 + "com/" + "x/" * 3000, "http://a.com#/en/", "http://a.com/?q", "://com/", "x://net/fr/",
]


def test_url_rules_fit_as_brute_force(spark, small):
    rows = [(i, u) for i, u in enumerate(ODD_URLS)]
    rows += [(100 + r.page_id, r.url) for r in table(spark, small, "pages").collect()]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_rules.judge(pages, url_rules.rules_of(queries.URL_RULES)).collect()}
    for i, url in rows:
        host, path, best = brute_url(url)
        assert (got[i].host, got[i].path) == (host, path), url
        assert got[i].rule == (best and best.split()[1])
        assert got[i].verdict == best.split()[0] if best else got[i].verdict in ("allow", "block")
    nothing = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(nothing, url_rules.rules_of(queries.URL_RULES)).count() == 0


def test_mined_rules_are_those_of_counting(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        basket = [f"{k}={rng.randint(0, 2)}" for k in "abc" if rng.random() < 0.9]
        rows.append((basket, "block" if "a=1" in basket or ("b=0" in basket and "c=2" in basket) else "allow"))
    counts = Counter()
    for basket, verdict in rows:
        for mask in range(1, 1 << len(basket)):
            own = frozenset(t for i, t in enumerate(basket) if mask >> i & 1)
            counts[own, verdict] += 1
    want = []
    for (own, verdict), n in counts.items():
        share = n / sum(counts[own, v] for v in ("allow", "block"))
        if n >= 0.05 * len(rows) and share >= 0.9:
            want.append(url_rules.TokenRule(own, verdict, share, n))
    frame = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    mined = url_rules.mine(frame, 0.05, 0.9)
    assert mined == url_rules.pruned(want) and mined
    index = url_rules.RuleIndex(mined, "allow")
    for basket, _ in rows:
        fired = [r for r in mined if r.tokens <= set(basket)]
        assert index.verdict(tuple(basket)) == (fired[0].verdict if fired else "allow")


# Fingerprints


def test_fingerprint_query(spark, small):
    rows = sorted(((r.doc_id, r.text or "") for r in table(spark, small).collect()), key=lambda r: -r[0])
    got = {r.doc_id: r for r in run("op6_fingerprints", spark, small).collect()}
    assert len(got) == len(rows)
    prints, errors = {}, []

    def grams(text):
        own = text.split()
        return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()

    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        row = got[doc]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint and 0 <= row.near_next <= 1
        for other, near in ((changed, row.near_edited), (following, row.near_next)):
            a, b = grams(text), grams(other)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1))
    assert np.abs(errors).mean() < 0.03 and abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.2


def test_fingerprint_odd_rows(spark, odd, none, odd_texts):
    rows = fingerprint.edited_fingerprints(odd).collect()
    ordered = sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t in odd_texts), key=lambda r: (-r[0], r[1]))
    want = Counter()
    for k, (_, text, doc) in enumerate(ordered):
        changed = fingerprint.edited(text, ordered[(k + 1) % len(ordered)][1])
        want[doc, len(text), hashlib.sha256(changed.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    assert fingerprint.edited_fingerprints(none).count() == 0
    one = fingerprint.edited_fingerprints(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest() and one.near_next == 1


# Toxicity


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    truth = table(spark, folder, "labels").select("doc_id", "toxic")
    rows = run("op7_toxicity", spark, folder).join(truth, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.8


@pytest.fixture(scope="module")
def insulting():
    rng = random.Random(7)
    plain = [words(rng, 40) + "." for _ in range(200)]
    rude = [f"{words(rng, 20)}. {words(rng, 5)} {rng.choice(['blockhead', 'nitwit', 'dimwit'])} {words(rng, 5)}." for _ in range(120)]
    return toxicity.fit(plain + rude, np.array([0] * 200 + [1] * 120)), rng


def test_toxicity_tolerates_gaps(insulting):
    model, rng = insulting
    table_ = toxicity.WordTable(model.word_scores)
    spelled = ["blockhead", "block-head", "bl.ock.head", "blo_ckhead", "n i t w i t", "N-i-T-w-i-t"]
    padded = ["bloxckhead", "blockheads", "nittwit", "dimwit7"]
    rude, table_ = model.text_scores(table_, [f"{words(rng, 8)} {s} {words(rng, 8)}." for s in spelled])
    near, table_ = model.text_scores(table_, [f"{words(rng, 8)} {s} {words(rng, 8)}." for s in padded])
    clean, _ = model.text_scores(table_, [words(rng, 25) for _ in range(50)] + ["", None])
    assert (rude > 0.5).all() and (clean < 0.5).all()
    assert np.median(near) > 2 * np.quantile(clean, 0.9)


def test_toxicity_of_spelled_out_runs(insulting):
    model, rng = insulting
    spell = lambda text: " ".join(text.replace(" ", ""))
    late = [f"{words(rng, 4)} {spell(words(rng, 15) + b + words(rng, 3))} {words(rng, 4)}." for b in ("blockhead", "nitwit")]
    # A run that ends a text and one that begins the next are two runs.
    border = [f"{words(rng, 8)} {spell('nitwit')}", f"{spell('dimwit')} {words(rng, 8)}", f"{spell('you')} {words(rng, 8)}"]
    got, table_ = model.text_scores(toxicity.WordTable(model.word_scores), late + border)
    assert (got[:4] > 0.5).all() and got[4] < 0.5
    assert np.allclose(got, [model.text_scores(table_, [t])[0][0] for t in late + border])
    # Fitting reads runs too: every insult of the sample is spelled out but for a few.
    plain = [words(rng, 40) + "." for _ in range(200)]
    rude = [f"{words(rng, 20)}. {words(rng, 5)} {b} {words(rng, 5)}." for b in ["blockhead"] * 10 + [spell("blockhead")] * 110]
    fitted = toxicity.fit(plain + rude, np.array([0] * 200 + [1] * 120))
    assert (fitted.text_scores(toxicity.WordTable(fitted.word_scores), rude)[0] > 0.5).all()


def test_kernel_is_the_sum_over_subsequences():
    def brute(s, t):
        def weights(x):
            out = Counter()
            for i in range(len(x)):
                for j in range(i + 1, len(x)):
                    for k in range(j + 1, len(x)):
                        out[x[i] + x[j] + x[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        a, b = weights(s), weights(t)
        return sum(a[u] * b[u] for u in a)

    pairs = [("idiot", "id.iot"), ("aaaa", "aaa"), ("ab", "abc"), ("", "abc"), ("loser", "closers")]
    got = toxicity.kernel(toxicity.letters([a for a, _ in pairs]), toxicity.letters([b for _, b in pairs]))
    assert np.allclose(got, [brute(*p) for p in pairs], rtol=1e-4)


def test_likeness_is_the_whole_kernel():
    marks = toxicity.Landmarks(["idiot", "worthless", "naïve"])
    spelled = ["ixdxxixxoxxt", "ixxdxxixxoxxt", "worthless", "wxoxrxtxhxlxexsxs", "naivë", "no", "", "ñ" * 48]
    want = toxicity.word_likeness(spelled, marks.words) ** toxicity.POWER
    assert np.allclose(marks.similar(spelled), want, rtol=1e-3, atol=0) and want[1, 0] > 0


def test_toxicity_odd_rows(spark, insulting, odd, none, odd_texts):
    model, _ = insulting
    rows = toxicity.scores(odd, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_texts)
    assert all(0 <= r.score <= 1 for r in rows) and toxicity.scores(none, model).count() == 0
    labels = spark.createDataFrame([(1, None), (1, 1), (None, 1), (99, 1)], "doc_id long, toxic int")
    alone = toxicity.fit(*toxicity.labelled_sample(odd, labels, "toxic", "true", 10))
    assert {round(r.score, 3) for r in toxicity.scores(odd, alone).collect()} == {1.0}
    empty = toxicity.fit(*toxicity.labelled_sample(odd, labels.limit(0), "toxic", "true", 10))
    assert {r.score for r in toxicity.scores(odd, empty).collect()} == {0.5}


# Exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        norm = "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "")
        groups[norm].append(doc)
    out = Counter()
    for norm, docs in groups.items():
        known = [d for d in docs if d is not None]
        keep = max(known) if known else None
        for d in docs:
            out[d, keep, len(docs), d == keep, hashlib.sha256(norm.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("budget", [8 << 20, 1])
def test_exact_groups(odd, none, odd_texts, monkeypatch, budget):
    monkeypatch.setattr(exact, "TRIE_BYTES", budget)
    assert Counter(map(tuple, exact.groups(odd).collect())) == brute_exact(odd_texts)
    assert exact.groups(none).count() == 0
    kept = exact.survivors(odd)
    assert kept.columns == odd.columns
    want = {(k[1], k[4]) for k in brute_exact(odd_texts)}
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted((k or -1) for k, _ in want)


def test_trie_tells_prefixes_apart():
    rng = random.Random(9)
    keys = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(3000)]
    trie, seen = exact.PatriciaTrie(), {}
    for key in keys:
        node = trie.insert(key)
        assert seen.setdefault(key, node) is node
    assert len(set(map(id, seen.values()))) == len(seen)
    assert exact.common_prefix(b"abcd", b"abxd") == 2 and exact.common_prefix(b"", b"a") == 0


# Chat formatting


def test_chat_round_trip(spark):
    odd = ["", None, "<|im_end|>", "\\<|im_start|>\n", "a\\", "<\\|", "<<||>>", "ends with <", "|", "日本\n\n"]
    rows = [(i % 3, i, r, t) for i, (r, t) in enumerate((r, t) for t in odd for r in ("user", "assistant", "o\nd<|d\\", None))]
    turns = spark.createDataFrame(rows + [(None, 0, "user", "x"), (2, 1, "user", "tie")], "conv_id int, turn int, role string, text string")
    out = chat.formatted(turns.withColumn("content", chat.text_part("text")).withColumn("rows", F.lit(1)))
    for r in out.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_mask"))).collect():
        own = sorted(((t, ro or "", x or "") for c, t, ro, x in map(tuple, turns.collect()) if c == r.conv_id))
        assert [tuple(b) for b in r.back] == [(ro, x) for _, ro, x in own] and r.n_turns == len(own)
        assert r.loss == "".join(x for _, ro, x in own if ro == "assistant")
    assert chat.formatted(turns.limit(0).withColumn("content", chat.text_part("text"))).count() == 0


def test_chat_typed_parts(spark):
    parts = [("text", "see <|x", None, None), ("image", None, "a.png", 28 * 28 * 3), ("text", None, None, None), ("document", None, "d.pdf", 9)]
    more = [("audio", None, "s.wav", 100), ("odd", "as text", None, None), None]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", more), (1, 2, "user", None)]
    r = chat.formatted(spark.createDataFrame(rows, f"conv_id int, turn int, role string, content array<{chat.PART}>")).first()
    user = "see <\\|x<|image_start|>0<|image_end|><|doc_start|>1<|doc_end|>"
    assistant = "<|audio_start|>2<|audio_end|>as text"
    assert r.formatted == f"<|im_start|>user\n{user}<|im_end|>\n<|im_start|>assistant\n{assistant}<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [tuple(a) for a in r.attachments] == [(0, 0, "image", "a.png", 5), (1, 0, "document", "d.pdf", 5), (2, 1, "audio", "s.wav", 5)]
    assert [r.formatted[a:b] for a, b in r.loss_mask] == [assistant]


# Quality


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    truth = table(spark, folder, "labels").select("doc_id", "quality")
    rows = run("op10_quality", spark, folder).join(truth, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_additive_model_needs_its_pairs():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    alone = quality.Additive(model.intercept, model.edges, model.tables, model.coarse, {})
    assert ((alone.scores(x[3000:]) >= 0.5) == y[3000:]).mean() < 0.7


def test_features_do_not_depend_on_the_batch(odd_texts):
    texts = [t for _, t in odd_texts]
    together = quality.text_features(pa.array(texts))
    alone = np.concatenate([quality.text_features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone)


def test_quality_odd_rows(spark, odd, none, odd_texts):
    labels = spark.createDataFrame([(1, 1), (7, 1), (11, 0), (12, 0), (12, None), (None, 0), (99, 1)], "doc_id long, quality int")
    x, y = quality.labelled_sample(odd, labels, "quality", "true")
    assert sorted(y) == [0, 0, 1, 1]
    model = quality.fit(x, y)
    rows = quality.scores(odd, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_texts) and all(0 <= r.score <= 1 for r in rows)
    assert quality.scores(none, model).count() == 0
    nothing = quality.fit(*quality.labelled_sample(none, labels, "quality", "true"))
    assert {r.score for r in quality.scores(odd, nothing).collect()} == {0.5}


# Entry


def test_all_operators_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
