"""Operators on tables, against brute force; odd tables in every operator."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallybook.llm import queries as q
from tallybook.llm.html_extract import extract_main_text
from tallybook.llm.language_id import identify
from tallybook.llm.licenses import scan_licenses
from tallybook.llm.line_dedup import LONG_WORDS, dedup_lines
from tallybook.llm.mixing import mix_sources, mixed_documents
from tallybook.llm.near_dedup import components, majority_fingerprint, near_duplicates, one_of_each, shingle_hashes
from tallybook.llm.pieces import decode_documents, encode_documents, piece_digests
from tallybook.llm.simhash import edited, edited_fingerprints, fingerprint, fingerprints, within_radius
from tallybook.llm.token_counts import count_tokens, truncate_to_budget
from tallybook.llm.topk import top_k

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS, PIECES = q.public_tokenizers.path(q.WORD_VOCABULARY), q.public_tokenizers.path(q.PIECE_VOCABULARY)

DOCUMENT_OPERATORS = {
    "tokens": lambda d: count_tokens(d, WORDS, 10),
    "truncated": lambda d: truncate_to_budget(d, WORDS, 10),
    "mix": mix_sources,
    "mixed": mixed_documents,
    "edited": edited_fingerprints,
    "fingerprints": fingerprints,
    "pieces": lambda d: piece_digests(d, PIECES),
    "lines": dedup_lines,
    "licenses": scan_licenses,
    "near": lambda d: near_duplicates(d, 3),
    "one": one_of_each,
    "languages": identify,
}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    long = "the word of a very long text " * 20_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "  \n ", "en", "", 3), (None, "null id", "en", "a", 7), (4, long, "en", None, len(long)), (5, "mit license é 日本", None, "b", 5), (5, "mit license é 日本", None, "b", 5), (5, "another text", "de", "b", 5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", DOCUMENT_OPERATORS)
def test_odd_tables(spark, odd, name):
    op = DOCUMENT_OPERATORS[name]
    n = op(odd).count()
    assert n == odd.count() or name in ("mixed", "one")
    assert op(spark.createDataFrame([], SCHEMA)).collect() == []
    extra = odd.select("*", *[F.lit(7).alias(c) for c in ("size", "fp", "u48", "rid", "pos", "n_tokens", "fingerprint", "labels", "score", "ids", "copies", "cell", "gone")])
    assert op(extra).count() == n


def test_pages(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    rows = [(1, "u", "<article><p>a  b</p></article>", "x", 1), (2, None, None, None, None), (None, "u", "", "x", 1), (1, "u", "<article><p>a  b</p></article>", "x", 1)]
    out = extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "", 0), (1, "a b", 3), (1, "a b", 3), (2, "", 0)]
    assert extract_main_text(spark.createDataFrame([], schema)).collect() == []


def test_round_trip_of_ids(documents):
    encoded = encode_documents(documents, PIECES)
    back = {r.doc_id: r.text for r in decode_documents(encoded, PIECES).collect()}
    assert back == {r.doc_id: r.text for r in documents.collect()}


def mixed_by_hand(rows, weights=(1, 2, 3), most=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(int)
    for r in rows:
        by[r.source] += size(r.text)
    names = sorted(by, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(by.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] >= most * by[s]}
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: float(most * by[s]) for s in over}
        left -= sum(most * by[s] for s in over)
        open_ -= over
    return size, by, target


def test_mix(spark, documents):
    skewed = documents.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 50 == 1, "tiny").when(F.col("doc_id") % 50 == 4, F.lit(None)).otherwise("rest"))
    rows = skewed.collect()
    size, by, target = mixed_by_hand(rows)
    out = mix_sources(skewed).collect()
    source = {r.doc_id: r.source for r in rows}
    text = {r.doc_id: r.text for r in rows}
    taken = Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.size == size(text[r.doc_id]) and r.source_size == by[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[s] += r.taken
    for s in by:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s], (s, taken[s], target[s])
    assert sorted(map(tuple, mix_sources(skewed.repartition(7)).collect())) == sorted(map(tuple, out))
    times = Counter(r.doc_id for r in mixed_documents(skewed).collect())
    assert times == Counter({r.doc_id: r.copies for r in out if r.copies})


def pareto_by_hand(rows, target, source_size, tolerance):
    """copies by doc_id of one source: down the order of random odds over inclusion odds."""
    from fractions import Fraction
    from math import sqrt

    certain = int(target // source_size)
    lacking, slack = target - certain * source_size, target * tolerance

    def score(r):
        u = Fraction(2 * int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:12], 16) + 1, 2**49)
        return float(u / (1 - u)) / sqrt(2 ** r.size.bit_length())

    order, total, took = sorted((r for r in rows if r.size), key=score), 0, set()
    for r in order if lacking > slack else []:
        if total <= lacking - slack and total + r.size <= lacking:
            total += r.size
            took.add(r.doc_id)
    left = [r for r in order if r.doc_id not in took and r.size < 2 * (lacking - total)]
    if left and lacking > slack and total <= lacking - slack:
        took.add(min(left, key=lambda r: (r.size, score(r))).doc_id)
    return {r.doc_id: certain + (r.doc_id in took) for r in rows}


@pytest.mark.parametrize("fold", [0, 5_000])
def test_pareto_order_within_a_source(spark, documents, monkeypatch, fold):
    import tallybook.llm.mixing as m

    monkeypatch.setattr(m, "FOLD_RANKS", fold)
    docs = documents.withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 5))
    source, by = {r.doc_id: r.source for r in docs.collect()}, defaultdict(list)
    for r in mix_sources(docs).collect():
        by[source[r.doc_id]].append(r)
    for rows in by.values():
        assert {r.doc_id: r.copies for r in rows} == pareto_by_hand(rows, rows[0].target, rows[0].source_size, m.TOLERANCE)
        certain = rows[0].target // rows[0].source_size
        sampled = [r for r in rows if r.size]
        # unequal probabilities, by which the sample is expected to hold just what is lacking
        assert len({r.p for r in sampled}) > 3 and all(0 < r.p < 1 for r in sampled)
        assert all(a.p <= b.p for a in sampled for b in sampled if a.size <= b.size)
        assert abs(sum(r.p * r.size for r in sampled) - (rows[0].target - certain * rows[0].source_size)) < 1e-3 * rows[0].target


def test_longer_documents_come_in_as_often_as_their_probability_says(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice((3, 30, 300)), "en", "a", 0) for i in range(6000)] + [(10_000 + i, "w " * 40, "en", "b", 0) for i in range(100)]
    out = [r for r in mix_sources(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id < 6000]
    for size in (3, 30, 300):
        own = [r for r in out if r.size == size]
        certain = own[0].target // own[0].source_size
        assert abs(sum(r.copies - certain for r in own) / len(own) - own[0].p) < 0.04


def test_edited_fingerprints(documents):
    rows = sorted(documents.collect(), key=lambda r: -r.doc_id)
    out = {r.doc_id: r for r in edited_fingerprints(documents.repartition(5)).collect()}
    for r, following in zip(rows, [*rows[1:], rows[0]]):
        new, o = edited(r.text, following.text), out[r.doc_id]
        assert o.n_chars == len(r.text) and o.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert (o.fingerprint, o.edited_fingerprint) == (f"{fingerprint(r.text):016x}", f"{fingerprint(new):016x}")


def test_edited_fingerprints_over_many_ranges(documents, monkeypatch):
    import tallybook.llm.simhash as s

    monkeypatch.setattr(s, "RANGE_ROWS", 9)
    many = sorted(map(tuple, edited_fingerprints(documents).collect()))
    monkeypatch.setattr(s, "MOST_RANGES", 3)
    assert many == sorted(map(tuple, edited_fingerprints(documents).collect()))
    monkeypatch.setattr(s, "RANGE_ROWS", 10**9)
    assert many == sorted(map(tuple, edited_fingerprints(documents).collect()))


def test_edited_fingerprints_of_rows_without_or_with_equal_ids(spark, monkeypatch):
    """They form ranges too, and each row's text meets the next one of the order."""
    import tallybook.llm.simhash as s

    monkeypatch.setattr(s, "RANGE_ROWS", 7)
    rng = random.Random(2)
    text = lambda: " ".join(rng.choices("alpha beta gamma delta epsilon".split(), k=9))
    rows = [(None, text()) for _ in range(60)] + [(4, text()) for _ in range(60)] + [(9, None), (1, text())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    exact = sorted((r.doc_id or 0, hashlib.sha256(edited(r.text or "", n.text or "").encode()).hexdigest()) for r, n in zip(order, [*order[1:], order[0]]))
    assert sorted((r.doc_id or 0, r.edited_sha256) for r in edited_fingerprints(docs.select("doc_id", "text")).collect()) == exact


def test_block_tables_find_all(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for x in base:
        for n in range(1, 6):
            prints.add(x ^ sum(1 << b for b in rng.sample(range(64), n)))
    df = spark.createDataFrame([(f"{x:016x}",) for x in prints], "fingerprint string")
    for radius, blocks in ((3, 6), (2, 4)):
        found = {(r.fingerprint, r.neighbour): r.distance for r in within_radius(df, df, radius, blocks).collect()}
        exact = {(f"{a:016x}", f"{b:016x}"): (a ^ b).bit_count() for a in prints for b in prints if a != b and (a ^ b).bit_count() <= radius}
        assert found == exact


def test_repeated_lines(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = line(LONG_WORDS + 5)
    block = [line(12) for _ in range(40)]
    boilerplate = line(10)
    docs = []
    for i in range(60):
        lines = [line(rng.randint(3, 20)) for _ in range(rng.randint(1, 12))]
        if i % 2:
            lines.insert(rng.randint(0, len(lines)), boilerplate)
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        if i % 20 == 7:
            lines[1:1] = block
        docs.append((i, "\n".join(lines), "en", "s", 0))
    docs.append((60, docs[4][1], "en", "s", 0))
    out = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert sum(passage in r.text for r in out.values()) == 1 and passage in out[0].text
    assert sum(r.text.count(boilerplate) for r in out.values()) >= 30
    kept = [sum(b in r.text for b in block) for r in (out[7], out[27], out[47])]
    assert kept == [40, 0, 0]
    for i, text, *_ in docs[:60]:
        if i % 3 and i % 20 != 7:
            assert out[i].text == text and out[i].n_chunks_removed == 0


def same_bytes_by_hand(docs):
    from tallybook.llm.line_dedup import line_chunks, line_pairs

    first, gone = {}, {f: defaultdict(set) for f in (line_chunks, line_pairs)}
    for i, text in sorted(docs):
        lines = text.split("\n")
        for f in gone:
            for a, b in f(lines):
                body = f, "\n".join(lines[a:b])
                if body in first:
                    gone[f][i].add(a)
                first.setdefault(body, (i, a))
    return gone[line_chunks], gone[line_pairs]


@pytest.mark.parametrize("hash_bits", [128, 12])
def test_line_dedup_by_hand(documents, hash_bits):
    """Also where many different chunks share a hash."""
    from tallybook.llm.line_dedup import without_chunks

    docs = [(r.doc_id, r.text) for r in documents.collect()]
    gone, pairs = same_bytes_by_hand(docs)
    out = {r.doc_id: (r.text, r.n_chunks_removed, r.n_lines_removed) for r in dedup_lines(documents, hash_bits).collect()}
    assert gone and pairs and out == {i: without_chunks(t, sorted(gone[i]), sorted(pairs[i])) for i, t in docs}


def test_line_dedup_in_rounds(documents, monkeypatch):
    import tallybook.llm.line_dedup as m

    whole = sorted((r.doc_id, r.text) for r in dedup_lines(documents).collect())
    monkeypatch.setattr(m, "FILTER_KEYS", 300)
    assert sorted((r.doc_id, r.text) for r in dedup_lines(documents).collect()) == whole


def test_passages_of_short_lines(spark):
    """Passages of more than 50 words in 2 to 8 lines of under 50 words, in other surroundings; the first one stays and no line is lost."""
    rng = random.Random(6)
    line = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    passages = [[line(n) for _ in range(k)] for k, n in ((2, 30), (3, 20), (4, 15), (5, 12), (8, 40)) for _ in range(6)]
    docs = []
    for k, passage in enumerate(passages):
        for i in range(3):
            before, after = [line(rng.randint(3, 20)) for _ in range(rng.randint(0, 6))], [line(rng.randint(3, 20)) for _ in range(rng.randint(1, 6))]
            body = [x for p in passage for x in (p, "")] if i == 1 and k % 2 else passage
            docs.append((3 * k + i, "\n".join(before + body + after), "en", "s", 0))
    out = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, SCHEMA)).collect()}
    for k, passage in enumerate(passages):
        kept = [sum(p in out[3 * k + i].split("\n") for p in passage) for i in range(3)]
        assert kept[0] == len(passage) and kept[2] == 0 and (kept[1] == 0 or k % 2)
    lines = {x for _, text, *_ in docs for x in text.split("\n")}
    assert lines == {x for text in out.values() for x in text.split("\n")}
    own = lambda i: [x for x in docs[i][1].split("\n") if x and x not in passages[i // 3]]
    assert all(set(own(i)) <= set(out[i].split("\n")) for i in range(len(docs)))


def test_top_k(spark, monkeypatch):
    import tallybook.llm.topk as t

    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 8)).astype(np.float32)
    base[100:300] = base[3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    # rows that repeat an id, with the same or another vector, also of queries
    again = [rows[5], rows[50], (50, rows[51][1]), (7, [9.0] * 8), (7, [-9.0] * 8)]
    ids = np.array([*range(700), *[i for i, _ in again]])
    base = np.concatenate([base, np.array([v for _, v in again], np.float32)])
    rows += again + [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] + [0.0] * 7), (None, rows[0][1]), (1200, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    q_ = np.floor(256 * base.astype(np.float64)).astype(np.int64)
    exact = []
    for i in np.flatnonzero(ids % 50 == 0).tolist():
        s = q_ @ q_[i]
        best = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        exact += [(int(ids[i]), r, int(ids[j]), int(s[j])) for r, j in enumerate(best, 1)]
    exact.sort()
    for size, block, walk in ((1 << 25, 10**6, 1000), (100 * 8 * 8, 4, 3)):
        monkeypatch.setattr(t, "SHARD_BYTES", size)
        monkeypatch.setattr(t, "BLOCK_QUERIES", block)
        monkeypatch.setattr(t, "WALK_QUERIES", walk)
        assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect())) == exact
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def contract_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union_by_hand(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_near_duplicates(documents):
    docs = {r.doc_id: contract_fingerprint(r.text) for r in documents.collect()}
    root = union_by_hand(sorted(set(docs.values())))
    least = {}
    for d in sorted(docs):
        least.setdefault(root[docs[d]], d)
    exact = {d: (f"{f:016x}", least[root[f]]) for d, f in docs.items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(documents, 3).collect()} == exact


def test_fingerprint_chains(spark, monkeypatch):
    """Random clusters and chains of fingerprints, against all pairs."""
    from tallybook.llm.near_dedup import links

    rng = random.Random(8)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 2, 3))))
    prints |= {0, (1 << 64) - 1, 1 << 63}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp bigint")
    found = {r.node: r.root for r in components(links(df)).collect()}
    exact = union_by_hand(sorted(prints))
    groups = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    own = {signed(x): found.get(signed(x), signed(x)) for x in prints}
    assert groups(own) == groups({signed(x): signed(r) for x, r in exact.items()})


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify(docs).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    judged = [r for r in out if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in judged) / len(judged) > 0.97


def test_no_labels_and_no_letters(spark):
    schema = "doc_id bigint, text string, lang string"
    assert {r.lang_pred for r in identify(spark.createDataFrame([(1, "abc", None)], schema)).collect()} == {"und"}
    one = spark.createDataFrame([(1, "abc def", "xx"), (2, "1234 --", "xx"), (3, None, "xx"), (7, "abd", None)], schema)
    assert {r.doc_id: r.lang_pred for r in identify(one).collect()} == {1: "xx", 2: "und", 3: "und", 7: "xx"}


def test_one_of_each(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    bodies = []
    for _ in range(30):
        words = [word() for _ in range(400)]
        bodies.append(words)
        for changes in (1, 3, 5, 40):
            copy = list(words)
            for at in rng.sample(range(400), changes):
                copy[at] = word()
            bodies.append(copy)
    bodies = [" ".join(b) for b in bodies] + ["", None, bodies[0][0], " ".join(bodies[0]).upper()]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(bodies)], SCHEMA)
    kept = {r.doc_id for r in one_of_each(docs).collect()}
    sets = [set(shingle_hashes(t or "", 5)) for t in bodies]
    same = [(t or "").lower().split() for t in bodies]
    like = lambda a, b: len(sets[a] & sets[b]) > 0 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = list(range(len(bodies)))
    for a, b in combinations(range(len(bodies)), 2):
        if same[a] == same[b] or like(a, b):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    assert kept == set(root)
    assert len(kept) < 85 and all(5 * i + 4 in kept for i in range(30))  # forty changed words are another text


def test_one_of_each_without_or_with_equal_ids(spark):
    """Unlike texts of one id and texts without an id stay, of equal rows one."""
    rng = random.Random(7)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(80))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (1, b), (1, b), (None, c), (None, c), (None, d), (7, d + " end"), (2, a.upper()), (None, a)]
    docs = spark.createDataFrame([(i, t, None, "s", k) for k, (i, t) in enumerate(rows)], SCHEMA)
    kept = sorted(((r.doc_id, r.text) for r in one_of_each(docs.repartition(3)).collect()), key=repr)
    assert kept == sorted([(1, a), (1, b), (None, c), (7, d + " end")], key=repr)


def test_texts_of_equal_fingerprint_are_told_apart(spark):
    """A shingle of more than half of a text makes its fingerprint, whatever the rest says."""
    rng = random.Random(4)
    tails = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(100)) for _ in range(2)]
    bodies = ["- " * 300 + t for t in tails] + [("- " * 300 + tails[0]).upper()]
    assert majority_fingerprint(bodies[0], 3) == majority_fingerprint(bodies[1], 3)
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(bodies)], SCHEMA)
    assert {r.doc_id for r in one_of_each(docs).collect()} == {0, 1}


def test_one_of_each_finds_all_pairs_of_a_dense_group(spark):
    """Texts around one long passage, by every kind of edit: the same classes as by comparing all pairs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage, bodies = [word() for _ in range(200)], []
    for i in range(120):
        own = passage + [word() for _ in range(rng.choice((20, 45, 60)))]
        bodies.append(own)
        at, n = rng.randrange(150), rng.randint(5, 30)
        copy = list(own)
        if i % 3 == 0:
            copy += [word() for _ in range(n)]
        elif i % 3 == 1:
            copy[at : at + n] = [word() for _ in range(n)]
        else:
            for k in rng.sample(range(200), 4):
                copy[k] = word()
        bodies.append(copy)
    bodies = [" ".join(b) for b in bodies]
    rng.shuffle(bodies)
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(bodies)], SCHEMA)
    sets = [set(shingle_hashes(t, 5)) for t in bodies]
    root = list(range(len(bodies)))
    for a, b in combinations(range(len(bodies)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    assert 10 < len(set(root)) < 230
    assert {r.doc_id for r in one_of_each(docs).collect()} == set(root)


@pytest.fixture(scope="module")
def large_group(spark):
    """1,500 texts around one passage that are alike to some of each other, as many copies of one text with other words in one place, and other texts."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage, base, bodies = [word() for _ in range(60)], [word() for _ in range(100)], []
    for i in range(1500):
        bodies.append(passage + [word() for _ in range(rng.choice((4, 8, 30)))])
        copy = list(base)
        copy[rng.randrange(100)] = word()
        bodies.append(copy)
    bodies += [[word() for _ in range(40)] for _ in range(200)]
    rng.shuffle(bodies)
    return [" ".join(b) for b in bodies]


def all_pairs_classes(bodies):
    """Least index of each text's class, by comparing every pair with shared shingles."""
    at: dict[int, list[int]] = defaultdict(list)
    sets = [set(shingle_hashes(t, 5)) for t in bodies]
    for i, s in enumerate(sets):
        for h in s:
            at[h].append(i)
    root = list(range(len(bodies)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, both in Counter(j for h in s for j in at[h] if j < i).items():
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in range(len(bodies))}


def test_one_of_each_of_a_large_group(spark, large_group):
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(large_group)], SCHEMA)
    exact = all_pairs_classes(large_group)
    assert 200 < len(exact) < 1900
    assert {r.doc_id for r in one_of_each(docs).collect()} == exact


def test_dirty_labels_are_bounded(spark, monkeypatch):
    import tallybook.llm.language_id as m

    monkeypatch.setattr(m, "MOST_LANGUAGES", 2)
    rows = [(i, f"text of label {i}", f"dirty-{i}") for i in range(60)] + [(100 + i, "ein deutscher satz", "de") for i in range(9)] + [(200 + i, "an english text", "en") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert m.fit(docs).languages == ["de", "en"]


def test_scratch_folder(spark):
    from tallybook.llm import common

    class Cluster:
        conf = type("conf", (), {"get": staticmethod(lambda name, other: None)})
        sparkContext = type("context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.scratch_dir(Cluster)
    before = len(common.kept_folders)
    kept = common.stored(spark.range(3))
    assert kept.count() == 3
    path = common.kept_folders[-1]
    common.clear_stored(spark, before)
    assert len(common.kept_folders) == before and not __import__("os").path.exists(path)


def test_pipeline(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == corpus_pipeline.COLUMNS
    assert all(b <= a for a, b in zip(seen, seen[1:])) and len(seen[2]) < len(seen[0])
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    for k, docs in enumerate((odd, odd.limit(0))):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}-{i}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{i}")
