"""Lexical search, prefix trie and quality rules against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labeltext.llm import lexical, prefix_trie, queries, rules

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Ranked lexical search


def searched(docs, items, k=20):
    """The formula, term by term: Counter of (item_id, rank, doc_id, score)."""
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    held = [(i, t, Counter(t)) for i, t in terms if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t, _ in held)
    df = Counter(w for _, _, c in held for w in c)
    out = Counter()
    for item, text in items:
        scores = []
        asked = TERM.findall((text or "").translate(LOWER))
        for doc, own, c in held:
            m = 100 - 25 + (25 * len(own) * n_docs) // n_terms
            score = 0
            for w in asked:
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += weight * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (score, null, doc) in enumerate(sorted(scores)[:k], 1):
            out[(item, rank, None if null else doc, -score)] += 1
    return out


def found(df):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


DOCS = "doc_id long, text string, item_id int, score string, rank string"
ITEMS = "item_id long, text string, doc_id string"


def test_search_odd_rows(spark):
    rng = random.Random(5)
    vocabulary = ["Apfel", "apfel", "birne", "日本", "naïve", "x", "42", "the", "THE", "ÀB", "àb", "a\x7fb", "e f"]
    texts = [rng.choice([" ", "-", "\n", "…"]).join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(300)]
    docs = [(i % 250, t) for i, t in enumerate(texts)] + [(None, "apfel 42"), (None, "apfel 42"), (7, None), (8, ""), (9, " -- ")]
    docs += [(1000, "birne " * 50_000 + "x"), (1001, "apfel42"), (1002, "pfel"), (1003, "x" * 100_000)]
    items = [(1, "Apfel the x"), (2, "birne birne 日本"), (3, None), (4, "..."), (5, "nowhere"), (6, "naïve àb a b e f 42")]
    items += [(1, "Apfel the x"), (None, "x 42")]
    frame = spark.createDataFrame([(*d, 3, "s", "r") for d in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(*i, "d") for i in items], ITEMS)
    want = searched(docs, items)
    assert found(lexical.ranked(frame, asked)) == want
    assert found(lexical.ranked(frame, asked, most_bytes=1)) == want  # a block and a scan per item
    assert found(lexical.ranked(frame, asked, k=3)) == searched(docs, items, 3)
    assert lexical.ranked(frame.limit(0), asked).count() == 0
    empty = lexical.ranked(frame, asked.limit(0))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert found(queries.op11_lexical_search(spark, small)) == searched(docs, items)


# Conversation prefix trie


def brute_trie(sequences):
    """Nodes of ``{conv_id: [(role, text), ..]}`` as a set of the operator's rows."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for path, convs in members.items():
        value = (len(convs) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += value
            leaves[path[:d]] += children[path] == 0
    out = set()
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        row = (min(convs), len(path), parent, len(convs), children[path], leaves[path], saved[path])
        out.add((*row, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def ordered(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(own)] for c, own in by.items()}


def shared_heads(sequences):
    out = {}
    for c, own in sequences.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = sequences.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(df):
    rows = [tuple(r) for r in df.select(COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def odd_turns():
    rng = random.Random(11)
    said = ["", "ab", "a", "b", "日本", "x" * 5000, "\x00", "1:user"]
    rows = []
    for c in [*range(-130, 420), 10**15, -(10**15)]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 9])):
            rows.append((c, rng.choice([turn, turn, turn, None, 1]), rng.choice(["user", "", None]), rng.choice([*said, None])))
    rows += [(None, 0, "user", "lost")] * 3 + [(5, 1, "user", "again")] * 2
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, node string, pos int, t0 string"


def test_trie_odd_rows(spark, odd_turns):
    frame = spark.createDataFrame([(*r, "n", 1, "t") for r in odd_turns], SCHEMA).repartition(4)
    sequences = ordered(odd_turns)
    assert nodes(prefix_trie.trie(prefix_trie.unchanged(frame))) == brute_trie(sequences)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    again = prefix_trie.rebuilt(frame, 100, head, 5)
    assert nodes(prefix_trie.trie(again)) == brute_trie(shared_heads(sequences))
    assert nodes(prefix_trie.trie(again, width=2)) == brute_trie(shared_heads(sequences))
    assert prefix_trie.trie(prefix_trie.unchanged(frame.limit(0))).count() == 0


def test_trie_of_long_conversations_and_copies(spark):
    rng = random.Random(2)
    trunk = [("user", f"t{i}") for i in range(75)]
    sequences = {c: trunk[: rng.randint(0, 75)] + [("a", f"own{rng.randint(0, 2)}")] * rng.randint(0, 20) for c in range(60)}
    sequences |= {1000 + c: trunk[:40] for c in range(3000)}
    rows = [(c, i, r, t, "n", 1, "t") for c, own in sequences.items() for i, (r, t) in enumerate(own)]
    frame = spark.createDataFrame(rows, SCHEMA)
    sequences = {c: own for c, own in sequences.items() if own}
    assert nodes(prefix_trie.trie(prefix_trie.unchanged(frame))) == brute_trie(sequences)


def test_ends_are_hashed_in_pieces(spark):
    ids = [(b"n" * 16, c) for c in range(-500, 500)] + [(b"m" * 16, 7)]
    rows = prefix_trie.ends_hash(spark.createDataFrame(ids, "node binary, conv_id long"), piece_bytes=50).collect()
    want = {b"n" * 16: ",".join(map(str, range(-500, 500))), b"m" * 16: "7"}
    assert {bytes(r.node): r.ends_sha256 for r in rows} == {n: hashlib.sha256(s.encode()).hexdigest() for n, s in want.items()}


def test_trie_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(queries.op12_prefix_trie(spark, small)) == brute_trie(shared_heads(ordered(rows)))


# Quality rules


def counted(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + o for i, w in enumerate(windows) if often[w] > 1 for o in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t\x0b\x0c\r ", "one", "one two", "a b c", "a b c a b c", "a a a a a", "a a a", "x y z 日本 語",
    "#*$%&|<> ## é", "l1\nl1\n l1\nl1 \n\n\n\nl2\r\nl2\r", "the cat and the dog " * 40, "the cat, and\n" * 30,
    " ".join(f"the word{i} of" for i in range(4000)), "w " * 30_000, "z" * 200_000, "- the a\n- of b\n" * 20, "\x00 \x1f\x85 a",
]


def test_rules_odd_rows(spark):
    rows = [(i % 12 if i % 5 else None, t, True, "l", "w") for i, t in enumerate(TEXTS + TEXTS[:3])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept boolean, l string, w string").repartition(3)
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in rules.judged(frame).collect()
    )
    want = Counter()
    for i, text, *_ in rows:
        n, chars, symbols, lines, repeated = counted(text)
        want[(i, n, chars, symbols, lines, repeated, n < 50 or 100 * repeated > 50 * n)] += 1
    assert got == want
    assert rules.judged(frame.limit(0)).count() == 0


def test_rules_verdicts(spark):
    prose = " ".join(f"the word{i} of day{i * 7}" for i in range(30))
    texts = {
        "": prose, "symbols": prose + " #" * 60, "stop_words": " ".join(f"wort{i}" for i in range(90)),
        "letters": prose + " 12 ? 7" * 0 + " ".join(f" {i}{i}" for i in range(300)), "marks": prose + " a!b!c!" * 1 + "!" * 80,
        "long_words": " ".join(f"the of {'y' * 60}{i}" for i in range(60)), "bullets": "\n".join(f"- the of a{i} b{i} c{i}" for i in range(40)),
        "ellipses": "\n".join(f"the of a{i} b{i} c{i}..." for i in range(40)), "repeated_lines": prose + "\nab" * 40,
    }
    frame = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    rows = {r.doc_id: r for r in rules.judged(frame).collect()}
    for i, name in enumerate(texts):
        assert not name or name in rows[i].failed, name
        assert rows[i].kept == (not rows[i].failed)
    assert rows[0].kept


def test_rules_table_is_a_parameter(spark):
    frame = spark.createDataFrame([(1, "a b c"), (2, "a b")], "doc_id long, text string")
    table = (rules.Rule("three", "n_words", 300, at_least=True), rules.Rule("few", "word_chars", 100, "n_words"))
    kept = {r.doc_id: (r.kept, r.failed) for r in rules.judged(frame, table, base=table[:1]).collect()}
    assert kept == {1: (True, []), 2: (False, ["three", "three"])}


def test_rules_need_no_python_worker_and_no_shuffle(spark, small):
    plan = queries.op13_quality_rules(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
