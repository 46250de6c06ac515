"""Importance resampling, language-model scores and fill-in-middle against brute force; markup and languages that were told wrongly before."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallybook.llm import backoff_lm, common, fill_in_middle, language_id, resampling
from tallybook.llm.html_extract import main_text
from tallybook.llm.near_dedup import one_of_each

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "A word of a very long text, é 日本\n" * 3_000


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "", "  \n ", "null id", LONG, "mit License é 日本", "mit License é 日本", "another text", "x" * 50_000, "a b c a b c a b c", "\n\n\n", "end<", "has <P> in it", "no end\nof line", "one\r\ntwo\n"]
    ids = [1, 2, 2, 3, None, 4, 5, 5, 5, 6, 7, 8, 9, 10, 11, 12]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids, texts)] + [(100 + i, f"word{i % 7} and word{i % 3} " * 15, "en", "a", 0) for i in range(60)], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# fill in the middle


def expected_fim(doc_id, text, changed=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= changed:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    spm = h[3] % 100 < suffix_first
    return len(units), "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("given", [{}, {"changed": 40, "suffix_first": 100}])
def test_fill_in_middle_equals_brute_force(odd, given):
    found = sorted(map(repr, (tuple(r) for r in fill_in_middle.fill_in_middle(odd, **given).collect())))
    assert found == sorted(repr((r.doc_id, *expected_fim(r.doc_id, r.text, **given))) for r in odd.collect())
    again = fill_in_middle.fill_in_middle(odd, **given).select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted(repr(tuple(r)) for r in again.collect()) == sorted(repr((r.doc_id, r.text or "")) for r in odd.collect())


def test_chunks_are_shared_and_never_cut_a_character():
    rng = random.Random(4)
    shared = "".join(rng.choice("abc é\n日") for _ in range(40_000))
    known = fill_in_middle.Chunks()
    fill_in_middle.Units(("own start " + shared).encode(), known)
    n = len(known)
    fill_in_middle.Units(("another and longer start\n" + shared).encode(), known)
    assert n > 20 and len(known) <= n + 3  # all but the first ones are met again
    for text in ("", "\n", "日" * 20_000, "a" * 40_000, "a\n" * 20_000, shared[:3]):
        ends = fill_in_middle.chunk_ends(text.encode())
        assert ends == sorted(set(ends)) and (ends[-1:] or [0]) == [len(text.encode())] and max(np.diff([0, *ends]), default=0) <= fill_in_middle.LONGEST
        for a, b in zip([0, *ends], ends):
            text.encode()[a:b].decode()


@pytest.mark.parametrize("mark", ["<P>", "<S>", "<M>"])
def test_marks_across_chunks_are_found(mark):
    known = fill_in_middle.Chunks()
    for at in range(fill_in_middle.LONGEST - 4, fill_in_middle.LONGEST + 2):
        assert fill_in_middle.Units(("a" * at + mark + "b" * 99).encode(), known).marked()
        assert not fill_in_middle.Units(("a" * at + mark[:2] + "b" * 99).encode(), known).marked()


def test_remembered_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "REMEMBERED", 10_000)
    known, rng = fill_in_middle.Chunks(), random.Random(5)
    for _ in range(50):
        fill_in_middle.Units(bytes(rng.choices(b"abc\n", k=5_000)), known)
    assert sum(map(len, known)) < 10_000 + fill_in_middle.LONGEST


# importance resampling


def expected_resample(rows, target, drawn=5, least=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    runs = lambda w: [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in runs(words(x))) for texts in ([r.text for r in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for r in rows:
        own = runs(words(r.text))
        h = int(hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in own)
        out.append([r.doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(r.text)) >= least])
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    most = drawn * len(fit) // 100
    return sorted(repr((*x[:4], next((i for i, y in enumerate(fit[:most], 1) if y is x), None))) for x in out)


@pytest.mark.parametrize("given", [{}, {"drawn": 50}, {"drawn": 100, "least_words": 0}])
def test_resampling_equals_brute_force(spark, odd, given):
    target = spark.createDataFrame([("word1 and word2 and",), (None,), ("",)], "text string")
    found = sorted(repr(tuple(r)) for r in resampling.resample(odd, target, **given).collect())
    want = expected_resample(odd.collect(), ["word1 and word2 and", None, ""], given.get("drawn", 5), given.get("least_words", 20))
    if given.get("least_words") == 0:  # rows of one key and score follow each other in any order
        found, want = (sorted(re.sub(r"^\((5|2), ([^)]*), \d+\)$", r"\1 \2", x) for x in y) for y in (found, want))
    assert found == want


def test_resampling_of_empty_tables(spark, odd):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(odd.limit(0), none).collect() == []
    assert resampling.resample(odd, none).count() == odd.count()
    assert {r.doc_id for r in resampling.drawn_texts(odd, none, drawn=100).collect()} == {r.doc_id for r in odd.collect() if r.doc_id and len(re.findall(r"\w+", r.text or "")) >= 20}


@pytest.mark.parametrize("n, kinds", [(0, 1), (1, 1), (5_000, 1), (5_000, 3), (5_000, 5_000)])
def test_sorting_by_regular_sampling(spark, n, kinds):
    """Exact ranks, also where all or a third of the rows are equal; no segment is much larger than the others."""
    df = spark.range(n).select("id", (F.xxhash64("id") % kinds).alias("k")).repartition(7)
    found = resampling.ranked(df, [F.col("k")])
    rows = found.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, n + 1)) and [r.k for r in rows] == sorted(r.k for r in rows)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 40)
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("abZ é日-_ \n9\x7f") for _ in range(rng.choice((0, 1, 30, 300))))
        monkeypatch.setattr(resampling, "PIECE", 1 << 20)
        whole = resampling.bucket_counts(text)
        monkeypatch.setattr(resampling, "PIECE", rng.choice((1, 7, 40)))
        parts = resampling.bucket_counts(text)
        assert (whole[0] == parts[0]).all() and whole[1] == parts[1]


# language-model scores


class PlainAutomaton:
    """States, arcs and failure arcs in dictionaries, from all training texts; walks a token at a time."""

    def __init__(self, texts, order, prior):
        self.order, self.prior = order, prior
        self.counts = Counter()
        for words in texts:
            own = ["<", *words, ">"]
            self.counts.update(tuple(own[i - k + 1 : i + 1]) for i in range(1, len(own)) for k in range(1, order + 1) if i - k + 1 >= 0)
            self.counts[("<",)] += 1
        ones = {g: c for g, c in self.counts.items() if len(g) == 1 and g != ("<",)}
        self.n, self.v = sum(ones.values()), len(ones)

    def base(self, word):
        return ((self.counts[(word,)] if word != "<" else 0) + 1) / (self.n + self.v + 1)

    def p(self, history, word):
        if not history:
            return self.base(word)
        return (self.counts[(*history, word)] + self.prior * self.p(history[1:], word)) / (self.counts[history] + self.prior)

    def walk(self, words):
        total, state = 0.0, ("<",) if self.order > 1 else ()
        for word in [*words, ">"]:
            at = state
            while at and not self.counts[at]:
                at = at[1:]
            while at and not self.counts[(*at, word)]:
                total += math.log10(self.prior / (self.counts[at] + self.prior))
                at = at[1:]
            total += math.log10(self.p(at, word))
            state = (*state, word)[-(self.order - 1) :] if self.order > 1 else ()
        return total


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


@pytest.mark.parametrize("order, given", [(1, {}), (2, {}), (2, {"block_tokens": 50, "piece": 30}), (3, {"prior": 0.7}), (4, {"block_tokens": 1, "piece": 1 << 20})])
def test_scores_equal_a_plain_automaton(odd, order, given):
    rows = odd.collect()
    plain = PlainAutomaton([tokens(r.text) for r in rows if not held_out(r.doc_id)], order, given.get("prior", backoff_lm.PRIOR))
    want = sorted((repr(r.doc_id), held_out(r.doc_id), len(tokens(r.text)) + 1, sum(plain.counts[(w,)] > 0 for w in [*tokens(r.text), ">"]), plain.n, sum(math.log10(plain.base(w)) for w in [*tokens(r.text), ">"]), plain.walk(tokens(r.text))) for r in rows)
    found = sorted((repr(r.doc_id), *tuple(r)[1:]) for r in backoff_lm.score(odd, order, **given).collect())
    assert [x[:5] for x in found] == [x[:5] for x in want]
    for a, b in zip(found, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_probabilities_sum_to_one():
    plain = PlainAutomaton([t.split() for t in ("a b a c", "b b", "", "a")], 3, 1.5)
    words = ["a", "b", "c", ">", "unknown"]
    for history in ((), ("a",), ("<", "a"), ("b", "b"), ("never", "a"), ("never",)):
        own = tuple(history)
        while own and not plain.counts[own]:
            own = own[1:]
        assert sum(plain.p(own, w) for w in words) == pytest.approx(1)


def test_scores_of_no_training(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert backoff_lm.score(empty).collect() == []
    i = next(i for i in range(99) if held_out(i))
    row = backoff_lm.score(spark.createDataFrame([(i, "a b", "en", "s", 3)], SCHEMA)).first()
    assert tuple(row) == (i, True, 3, 0, 0, 0.0, 0.0)


def test_frequent_words_and_pairs_score_right(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("the same pair "), 20), F.when(F.col("id") % 3 == 0, "the").otherwise(F.col("id").cast("string"))).alias("text"))
    rows = df.collect()
    plain = PlainAutomaton([tokens(r.text) for r in rows if not held_out(r.doc_id)], 2, backoff_lm.PRIOR)
    found = {r.doc_id: r.score for r in backoff_lm.score(df, block_tokens=900).collect()}
    assert found == pytest.approx({r.doc_id: plain.walk(tokens(r.text)) for r in rows}, rel=1e-9)


# other columns with the operators' own names


CLASHING = ["n", "form", "output", "weight", "score", "rank", "key", "number", "block", "part", "bucket", "__h1", "__k0", "__at", "__segment"]


def test_scores_of_more_partitions_than_cores(spark):
    docs = spark.createDataFrame([(i, f"word{i % 11} of document {i} " * (1 + i % 5)) for i in range(240)], "doc_id bigint, text string")
    many = docs.repartition(12 * spark.sparkContext.defaultParallelism)
    rows = [sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in backoff_lm.score(d, block_tokens=20).collect()) for d in (docs.coalesce(1), many)]
    assert len(rows[0]) == 240 and rows[0] == rows[1]


def test_numbers_are_packed_without_their_upper_zeros():
    for most, width in ((0, 1), (255, 1), (256, 2), (2**31 - 1, 4), (2**63 - 1, 8)):
        numbers = np.array([0, most, most // 3], np.int64)
        data = backoff_lm.packed(numbers)
        assert len(data) == 1 + 3 * width and backoff_lm.unpacked(data, np.int64).tolist() == numbers.tolist()
    assert backoff_lm.unpacked(backoff_lm.packed(np.array([2**64 - 1], np.uint64)), np.uint64).tolist() == [2**64 - 1]


def test_a_task_has_few_blocks_at_a_time(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda j: F.concat_ws("-", "id", j))
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    before = len(common.kept_folders)
    assert backoff_lm.score(docs, block_tokens=60_000).count() == 40
    groups = [m.row_group(i) for f in Path(common.kept_folders[before].removeprefix("file:")).glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 40 and sum(g.total_byte_size for g in groups) > 32e6
    assert max(g.total_byte_size for g in groups) < 16e6


def test_more_text_is_dealt_to_more_tasks(spark, monkeypatch):
    cores, before = spark.sparkContext.defaultParallelism, len(common.kept_folders)
    docs = spark.range(0, 960, 1, 24 * cores).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 10).alias("text"))
    for most in (backoff_lm.TASK_BYTES, 960 * 110 // (3 * cores)):
        monkeypatch.setattr(backoff_lm, "TASK_BYTES", most)
        assert backoff_lm.score(docs).count() == 960
    files = [len(list(Path(f.removeprefix("file:")).glob("*.parquet"))) for f in common.kept_folders[before :: 3]]
    assert files == [cores, 3 * cores]


def test_clashing_columns_change_nothing(spark, odd):
    more = odd.withColumns({c: F.lit("x") for c in CLASHING})
    target = spark.createDataFrame([("word1", 7)], "text string, bucket int")
    for run in (fill_in_middle.fim_digests, backoff_lm.score, lambda d: resampling.resample(d, target, drawn=50)):
        assert sorted(repr(tuple(r)) for r in run(more).collect()) == sorted(repr(tuple(r)) for r in run(odd).collect())


# pages


P = "<p>This is a sentence of the article that is long enough to count as its text, with some more words.</p>"


@pytest.mark.parametrize(
    "html, text",
    [
        ('<p title="see <b>bold</b> part">This is the text of a paragraph that is long enough to stand for itself here.</p>', "This is the text of a paragraph that is long enough to stand for itself here."),
        (f"{P}<div class='ad' data-tip='<em>tip</em>'>Buy this thing now, it is a very long advert that nobody wants to read at all.</div>", main_text(P)),
        (f'<p data-x="a>b">{P[3:]}', main_text(P)),
        (f'<p title="never closed>{P[3:]}', main_text(P)),
        (f'<p title=">" class = \'a"b\'>{P[3:]}', main_text(P)),
        (f"<body><form action='x'><input type='hidden'>{P * 3}</form></body>", "\n".join([main_text(P)] * 3)),
        (f"<div id='social-content'><h1>A title of the page</h1>{P * 2}</div>", "A title of the page\n" + "\n".join([main_text(P)] * 2)),
        (f"<div class='menu-page'>{P * 2}</div><div class='menu'>one two three four five six seven</div>", "\n".join([main_text(P)] * 2)),
        (f"<div class='search-content'>{P * 2}</div>", "\n".join([main_text(P)] * 2)),
        (f"<article>{P}</article><form><label>Name</label><input><label>Mail</label><input><p>Please fill in all of the fields above, we will answer soon.</p></form>", main_text(P)),
        (f"<article>{P}</article><div class='comments'>{P * 9}</div><div class='cookie-notice'><h1>x</h1>{P * 9}</div><div hidden>{P * 9}</div>", main_text(P)),
        (f"<div class='subscribe'>{P}</div><article>{P * 2}</article>", "\n".join([main_text(P)] * 2)),
    ],
)
def test_markup_and_containers(html, text):
    assert main_text(html) == text and "<" not in main_text(html)


@pytest.mark.parametrize("page", ["<div>x y z " * 250_000, "<div>" * 600_000, "<svg>" * 600_000, "<p title='a' class=\"" * 150_000, "</div>" * 500_000, "<button>" * 300_000 + "</button>", "<a <b " * 400_000, "<div class='" * 200_000])
def test_large_and_deep_pages_take_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 12


# languages, near-duplicates


def test_only_letters_tell_a_language():
    import sys
    import unicodedata

    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.category(c) != "Cs":
            assert language_id.has_letter(f"1{c}½") == (unicodedata.category(c)[0] == "L"), hex(i)


def test_all_labels_are_learned(spark):
    rng = random.Random(7)
    names = [f"l{i}" for i in range(300)]
    words = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for x in names}
    rows = [(i, " ".join(rng.choices(words[names[i % 300]], k=25)), names[i % 300], "s", 0) for i in range(3_000)] + [(9_001, "½ ²", None, "s", 0), (9_002, None, None, "s", 0)]
    found = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    right = [found[i].lang_pred == lang for i, _, lang, _, _ in rows if lang and found[i].held_out]
    assert len(right) > 400 and sum(right) > 0.9 * len(right)
    assert {found[9_001].lang_pred, found[9_002].lang_pred} == {"und"}


def plain_model(rows):
    """(languages, codes, weights, scale, trust) of the labelled rows that are not held out, in plain numbers."""
    totals = {}
    for doc_id, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5:
            own = language_id.ngram_counts(text)
            totals[lang] = totals.get(lang, 0) + own * language_id.UNIT // max(1, own[: language_id.BUCKETS].sum())
    languages = sorted(totals)
    shares = np.array([(totals[k].reshape(3, -1) / np.maximum(totals[k].reshape(3, -1).sum(axis=1, keepdims=True), 1)).ravel() for k in languages])
    codes = language_id.codewords(len(languages))
    weights = np.log((np.array([shares[codes[:, j] > 0].mean(axis=0) if (codes[:, j] > 0).any() else 0 * shares[0] for j in range(codes.shape[1])]) + 1e-5) / (np.array([shares[codes[:, j] < 0].mean(axis=0) if (codes[:, j] < 0).any() else 0 * shares[0] for j in range(codes.shape[1])]) + 1e-5)).T
    margins = shares @ weights
    scale = np.maximum(np.abs(margins).mean(axis=0), 1e-9)
    return languages, codes, weights, scale, np.maximum(margins * codes / scale, 0.05)


def test_model_and_predictions_equal_plain_numbers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    languages, codes, weights, scale, trust = plain_model(rows)
    model = language_id.fit(docs)
    assert model.languages == languages and (model.codes == codes).all()
    for own, plain in ((model.weights, weights), (model.scale, scale), (model.trust, trust)):
        assert np.allclose(own, plain, rtol=1e-6)
    found = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for doc_id, text, _ in rows:
        own = language_id.ngram_counts(text or "").reshape(3, -1)
        signs = np.clip((own / np.maximum(own.sum(axis=1, keepdims=True), 1)).ravel() @ weights / scale, -4, 4)
        loss = (trust * np.exp(-codes * signs)).sum(axis=1) / trust.sum(axis=1)
        if any(c.isalpha() for c in text or ""):
            assert found[doc_id].lang_pred == languages[int(loss.argmin())]
            assert found[doc_id].score == pytest.approx(1 / loss.min() / (1 / loss).sum(), rel=1e-6)


def test_rows_are_told_apart_by_whole_digests(spark, monkeypatch):
    """Two unlike documents whose short keys are the same both stay."""
    import tallybook.llm.near_dedup as near

    class Colliding:
        def __getattr__(self, name):
            return (lambda *c: F.lit(7).cast("long")) if name == "xxhash64" else getattr(F, name)

    monkeypatch.setattr(near, "F", Colliding())
    rows = [(i, f"text number {i} about " + " ".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest()[:6] for k in range(30)), "en", "s", 0) for i in range(6)]
    rows += [rows[0], (9, rows[1][1], "en", "s", 0)]
    assert sorted(r.doc_id for r in one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()) == [0, 1, 2, 3, 4, 5]


def test_pipeline_drops_what_fingerprints_link(spark):
    import corpus_pipeline
    from tallybook.llm import near_dedup as m

    words = [f"w{i}" for i in range(400)]
    spread = [f"x{i}" if i % 19 == 7 else w for i, w in enumerate(words)]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate((words, spread, [f"y{i}" for i in range(300)], words))]
    docs = spark.createDataFrame([(None, rows[0][1], "en", "s", 1), *rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    linked = {r.component_id for r in m.near_duplicates(docs, 3).collect()}
    found = [r.doc_id for r in m.one_of_each_class(docs, 3).collect()]
    assert sorted(found) == sorted(linked) and 3 not in found
    assert set(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) <= set(found)
