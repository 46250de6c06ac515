"""Operators on single texts, against brute force and the libraries of the vocabularies."""

import itertools
import re
from re import _parser as re_parser

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybook.llm.html_extract import SURGE, WINDOW, effective_lengths, main_text, page_lines
from tallybook.llm.language_id import codewords
from tallybook.llm.licenses import BASE, MACROS, RULES, detections, matches, scan, signature_rules
from tallybook.llm.line_dedup import line_chunks, without_chunks
from tallybook.llm.pieces import PieceModel
from tallybook.llm.simhash import edited, fingerprint, likeness
from tallybook.llm.token_counts import PrefixCounter

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t.,'aeEtsmdlrv<|>ΣİßéÅ½９ 　▁")), max_size=60)

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class="ad">Buy &amp; save</div><div id="sidebar"><p>Side text that is long enough to be taken for a paragraph of text.</p></div>
<article><header><h1>Title &lt;1&gt;</h1></header><p>First  para
graph &amp; more.</p><!-- <p>hidden</p> --><p>Ok.</p><aside>Aside</aside><ul><li>Item <a href="x>y">one</a></li></ul><p></p><p>Last
</article><section id="comments"><p>Great post, thanks for all of it, really good.</p></section>
<form><p>Your mail</p></form><footer>&copy; us</footer></body></html>"""


def test_article_text():
    assert main_text(PAGE) == "Title <1>\nFirst para graph & more.\nOk.\nItem one\nLast"


def test_page_without_article():
    body = "".join(f"<p>{'words of the text ' * 5}{i}.</p>" for i in range(4))
    page = f"<body><div class=menu><a href=/>a</a></div><div>{body}</div><div class=footer>foot</div><p><a href=/x>only a link</a></p></body>"
    assert main_text(page).count("\n") == 3 and "foot" not in main_text(page)


@pytest.mark.parametrize("html", [None, "", "<p", "<nav>a</nav>", "<!--", "<script>x"])
def test_pages_without_text(html):
    assert main_text(html) == ""


def test_cut_off_page():
    assert main_text("<article><p>One &am") == "One &am"
    assert main_text("<article><p>One &amp") == "One &"
    assert main_text("<article><p>One</p><p") == "One"


LONG = "some words of a long paragraph " * 4


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<div class="article-body"><p>{LONG}</p></div><article><h3>Read next</h3><p>teaser</p></article>', LONG.strip()),
        (f'<article><p>First.</p><div class="share-price"><p>Share price rose.</p></div><p>{LONG}</p></article>', f"First.\nShare price rose.\n{LONG.strip()}"),
        (f'<article><p>First.</p><div class="share-buttons"><p>Share it</p></div><p>{LONG}</p></article>', f"First.\n{LONG.strip()}"),
        ("<article><p>a first part</p><button>Share<p>second part</p><p>third</p></article>", "a first part\nShare\nsecond part\nthird"),
        ("<article><p>a first part</p><svg><path d='x'><p>second part</p></article>", "a first part\nsecond part"),
        ("<article><p>a</p><select><option>1</option></select><object><p>b</p></article>", "a\nb"),
        (f"<article><p>{LONG}</p></article><article><p>{LONG}2</p></article>", f"{LONG.strip()}\n{LONG.strip()} 2"),
        (f"<body><p>{LONG}</p><p>{LONG}</p><div>x</div></body>", f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><ul><li><a href=a>Link one</a></li><li><a href=b>Link two</a></li></ul></article>", LONG.strip()),
        (f"<article><p>{LONG}</p><p><a href=a>A linked line</a></p><p>{LONG}</p></article>", f"{LONG.strip()}\nA linked line\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><div id='reader-comments'><p>{LONG}</p></div></article>", LONG.strip()),
    ],
)
def test_shapes_of_pages(html, text):
    assert main_text(html) == text


@pytest.fixture(scope="module")
def page_rows():
    import duckdb

    return [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]


def line_blocks_by_hand(html):
    """Surge and dive points one line at a time, from the effective lengths."""
    lines = page_lines(html)
    effective = effective_lengths(lines)
    n = len(lines)
    total = lambda a, b: sum(effective[i] or 0 for i in range(max(0, a), min(n, b)))
    top = max((total(i, i + WINDOW) for i in range(n)), default=0)
    kept = []
    for i in range(n):
        ahead, behind = total(i, i + WINDOW) >= min(SURGE, top), total(i - WINDOW + 1, i + 1) >= min(SURGE, top)
        if top and effective[i] is not None and ((ahead or behind) if effective[i] else (ahead and behind)):
            kept.append(lines[i].text)
    return "\n".join(kept)


def test_line_blocks_decide(page_rows):
    """Without the article tag the windows alone find the same text, and without windows it is another one."""
    bare = [re.sub("</?article>", "<div>", html) for html in page_rows]
    whole = [main_text(html) for html in page_rows]
    assert whole == [line_blocks_by_hand(html) for html in page_rows] and all(whole)
    assert [main_text(html) for html in bare] == whole == [line_blocks_by_hand(html) for html in bare]
    assert sum(main_text(html, window=1) != text for html, text in zip(bare, whole)) > len(bare) / 4


@given(st.text(max_size=200))
@settings(max_examples=100, deadline=None)
def test_any_html(html):
    assert all(x.strip() for x in main_text(html).split("\n") if main_text(html))


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(WORDS)


@given(ODD)
@settings(max_examples=300, deadline=None)
def test_token_counts(counter, word_library, text):
    assert counter.count(text) == len(word_library.encode(text, add_special_tokens=False).ids)


def test_special_names_and_long_texts(counter, word_library):
    for text in ("a<|endoftext|>b <|startoftext|>", "<|endoftext|", "x" * 5000, "hello world " * 3000, ""):
        assert counter.count(text) == len(word_library.encode(text, add_special_tokens=False).ids)


def test_all_pairs_of_low_characters(counter, word_library):
    """Letters below U+0250 may have small ones beyond it."""
    low = [chr(i) for i in range(1, 0x250)]
    for a in low:
        pairs = [a + b for b in low]
        exact = [len(x.ids) for x in word_library.encode_batch_fast(pairs, add_special_tokens=False)]
        assert [counter.count(x) for x in pairs] == exact


#: Composing and lone marks, sigmas, contractions, conjoining jamo, letters that change their length, odd spaces.
PREFIX = st.text(st.sampled_from(" '\n.,-!sStTrevVlLdDmMaebé\u0301\u0327\u0323ΣσςİıßÅ½9٣日本ไทยุ์हिन्दी각\u1100\u1161\u11a8\u018f\u0181\u023a<|>\u00a0\u2028\u0085\x1c…—“’"), max_size=16)


@given(PREFIX, PREFIX, st.sampled_from(["", "<|endoftext|>", "<|endof", "<|startoftext|>"]))
@settings(max_examples=400, deadline=None)
def test_every_prefix(counter, word_library, before, after, name):
    text = before + name + after
    exact = [len(word_library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert counter.prefix_counts(text) == exact and counter.count(text) == exact[-1]
    for budget in (0, 1, 3, 7):
        n = len(counter.truncate(text, budget))
        assert max(exact[: n + 1]) <= budget and (n == len(text) or exact[n + 1] > budget)


@pytest.mark.parametrize("text", ["Это довольно длинный текст по-русски. " * 500, "it's a long text, isn't it? “Yes”, she'd say. " * 400, "日本語のテキスト" * 500, "ภาษาไทยเป็นภาษาที่" * 300, "x" * 8000])
def test_prefixes_of_long_texts_take_no_new_encoding(counter, word_library, text):
    calls = []
    whole, counter.split = counter.split, lambda t: calls.append(len(t)) or whole(t)
    try:
        counts = counter.prefix_counts(text)
    finally:
        del counter.split
    assert sum(calls) < 4 * len(text)
    for i in [*range(0, len(text), len(text) // 20), len(text)]:
        assert counts[i] == len(word_library.encode(text[:i], add_special_tokens=False).ids)


def test_memory_of_words_and_pairs_is_bounded(monkeypatch):
    import tallybook.llm.token_counts as t

    monkeypatch.setattr(t, "REMEMBERED", 50)
    own = PrefixCounter(WORDS)
    for i in range(300):
        own.count(f"word{i}abc other{i * 7}xyz " + "y" * 100)
        assert len(own) <= 50 and len(own.pairs) <= 50 and all(len(w) <= t.LONGEST_REMEMBERED for w in own)


@pytest.fixture(scope="module")
def pieces():
    return PieceModel(PIECES)


@given(ODD)
@settings(max_examples=300, deadline=None)
def test_encoding_equals_the_library(pieces, text):
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=PIECES)
    ids = pieces.encode(text).tolist()
    assert ids == lib.encode(text)
    assert pieces.decode(ids) == text.replace("▁", " ")


def test_viterbi_by_scores_is_the_best_of_all_segmentations():
    model = PieceModel(PIECES, merges=False)
    for text in ("thein", "▁anderen", "xqzthe", "▁▁ab", "of▁"):
        best = None
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(text[at:i])
                    at = i
            parts.append(text[at:])
            if all(p in model.score or len(p) == 1 for p in parts):
                total = sum(model.score.get(p, model.least) for p in parts)
                best = total if best is None else max(best, total)
        ids = model.viterbi(text)
        found = sum(model.score.get(model.pieces[i], model.least) for i in ids)
        assert found == best


def test_likeness():
    text = "one two three four five six seven eight nine ten " * 3
    assert fingerprint("") == 0 and fingerprint(" \n") == 0
    assert likeness(5, 5) == 1.0 and likeness(0, (1 << 64) - 1) == 0.0
    assert fingerprint(text) == fingerprint(text)
    assert edited("abcdefg", "xyz") == "abcdexy" and edited("abcdefghi", "x") == "abcdefx" and edited("ab", "x") == "ab"


def test_rules_are_hundreds():
    assert len({r.pattern.pattern for r in signature_rules()}) == len(RULES.strip().split("\n")) >= 250


def test_license_labels():
    assert scan("") == (0, 0, None, None, "", "", 0.0)
    n, base, first, last, labels, more, score = scan("See the MIT\nLicense. mit-license! No emit license; GNU General  Public License")
    assert (n, base, first, last, labels) == (13, 3, 2, 9, "gpl,mit") and 0 < score <= 1
    assert scan("Licensed under CC BY-NC 4.0.")[4:6] == ("cc-by", "cc-by,cc-by-nc")
    assert scan("Licensed under the Apache License, Version 2.0")[5] == "apache"
    assert scan("GNU Lesser General Public License v2.1")[4:6] == ("", "lgpl")
    assert scan("SPDX-License-Identifier: BSD-3-Clause")[5] == "bsd"
    assert scan("ein wort mit licht und gnu general lizenz") == (8, 0, None, None, "", "", 0.0)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("SPDX-License-Identifier: AGPL-3.0", "agpl"),
        ("licensed under AGPL v3", "agpl"),
        ("under the terms of the GNU Library General Public License", "lgpl"),
        ("licensed under Creative Commons Zero", "cc0"),
        ("licensed under the PSF license", "python"),
        ("licensed under the Creative Commons Attribution ShareAlike", "cc-by-sa"),
        ("licensed under the Creative Commons Attribution-NonCommercial", "cc-by-nc"),
        ("licensed under the Creative Commons Attribution-NoDerivatives", "cc-by-nd"),
        ("licensed under the Creative Commons Attribution-NonCommercial-ShareAlike", "cc-by-nc-sa"),
        ("licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives", "cc-by-nc-nd"),
    ],
)
def test_license_names_without_other_keywords(text, label):
    assert label in scan(text)[5].split(",") and (label == "cc-by" or "cc-by" not in scan(text)[5].split(","))


def spelled(nodes):
    """The texts that a parsed pattern of words stands for."""
    out = [""]
    for kind, of in nodes:
        if kind is re_parser.LITERAL:
            ways = [chr(of)]
        elif kind is re_parser.IN:
            ways = [chr(x) if k is re_parser.LITERAL else chr(x[0]) for k, x in of]
        elif kind is re_parser.BRANCH:
            ways = [w for branch in of[1] for w in spelled(branch)]
        elif kind is re_parser.SUBPATTERN:
            ways = spelled(of[-1])
        else:
            assert kind is re_parser.MAX_REPEAT, kind
            ways = (["", *spelled(of[2])] if of[0] == 0 else spelled(of[2]))
        out = [a + b for a in out for b in ways]
    return out


def test_every_rule_fires_through_its_keyword():
    plain = {"l": "license", "v": "(?:2|version 2 0|v ?3)", "w": "(?: 2 0)?", "g": "licensed under the ", "s": "spdx license identifier "}
    sampled = signature_rules(plain)
    whole = signature_rules()
    lines = RULES.strip().split("\n")
    assert len(sampled) == len(whole) == len(lines)
    for r in sampled:
        for text in spelled(re_parser.parse(r.pattern.pattern.decode()[9 : -len("(?![^ ])")])):
            words = text.encode()
            assert r.keyword in words and any(m.label == r.label and m.end == len(words) for m in matches(words)), text
            assert not any(m.label == r.label and m.priority == r.priority and m.end == len(words) + 1 for m in matches(words + b"x"))


def test_the_keyword_filter_changes_nothing():
    import duckdb

    for (text,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall():
        words = b" ".join(re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower()))
        every = {(r.label, m.end()) for r in signature_rules() for m in r.pattern.finditer(words)}
        assert {(m.label, m.end) for m in matches(words)} == every


def test_common_parts_of_rules():
    grant, version, line = (re.compile(MACROS[x]) for x in ("g", "v", "s"))
    for words in ("licensed under the ", "released under ", "distributed under the terms of the ", "subject to the terms and conditions of the ", "provided by a ", "copy of the ", "under the terms of the "):
        assert grant.fullmatch(words)
    for words in ("2", "version 2 0", "v2 0", "v 1 1", "3 0 or later", "2 0 only", "1 0 0"):
        assert version.fullmatch(words)
    assert line.fullmatch("spdx license identifier ") and line.fullmatch("spdx license identifier mit or ")


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
        ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "cc-by-nc-nd"),
        ("Creative Commons Attribution-NonCommercial 4.0 License", "cc-by-nc"),
        ("released under the AGPL v3", "agpl"),
        ("SPDX-License-Identifier: AGPL-3.0-only", "agpl"),
        ("licensed under the PSF license", "python"),
        ("Creative Commons Zero license", "cc0"),
        ("SPDX-License-Identifier: EPL-2.0", "epl"),
        ("SPDX-License-Identifier: CDDL-1.0", "cddl"),
        ("SPDX-License-Identifier: OFL-1.1", "ofl"),
        ("SPDX-License-Identifier: EUPL-1.2", "eupl"),
        ("licensed under the GPLv3", "gpl"),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache,mit"),
        ("GPL-2.0-or-later", "gpl"),
        ("BSD 3-Clause License", "bsd"),
        ("http://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"),
        ("GNU Affero General Public License version 3", "agpl"),
        ("the committee will submit it, das Licht mit der Lizenz, a gpl of text, psf and epl, bsd systems, a zero license", ""),
        ("the apache helicopter, an eclipse in public, open data, artistic freedom, a boost, to curl up", ""),
    ],
)
def test_license_probes(text, labels):
    assert scan(text)[5] == labels


@given(st.lists(st.sampled_from("gnu general public license apache cc by mit x é 9".split()), max_size=30))
@settings(max_examples=200, deadline=None)
def test_base_places(words):
    n, base, first, last, labels, *_ = scan(" - ".join(words))
    places = sorted((i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    assert (n, base, labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
    assert (first, last) == ((places[0][0], places[-1][0]) if places else (None, None))


def test_contained_detections_go():
    found = detections(b"licensed under the apache license version 2 0")
    assert len(found) == 1 and found[0].end - found[0].start == len(b"licensed under the apache license version 2 0")


def test_chunks_shift_along():
    lines = [f"line {i} " + "word " * 6 for i in range(200)]
    whole = {tuple(lines[a:b]) for a, b in line_chunks(lines)}
    shifted = {tuple(x[a:b]) for x in (["new first line of it"] * 5 + lines,) for a, b in line_chunks(x)}
    assert len(whole & shifted) >= len(whole) - 2
    text = "\n".join(lines)
    a, b = line_chunks(lines)[3]
    assert without_chunks(text, [a]) == ("\n".join(lines[:a] + lines[b:]), 1, b - a)


def test_codewords_are_apart():
    for n in (2, 4, 9, 30):
        codes = codewords(n)
        apart = min((a != b).sum() for a, b in itertools.combinations(codes, 2))
        assert apart >= 5 and not (abs(codes.sum(axis=0)) == n).any()


def test_word_pattern_matches_contract():
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "aB9 é-x_Z\x7f日".replace("B", "b").replace("Z", "z"))
    assert scan("aB9 é-x_Z\x7f日")[0] == len(own)
