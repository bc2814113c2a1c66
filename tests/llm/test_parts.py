"""Pure parts of the operators: hashes, checksums, sketches, grammar, images, markup, suffix arrays, encoders."""

import random
import re
import zlib
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparklog.llm import chat, decontaminate, encode, html, language, media, neardup, pack, quality, records, substring
from sparklog.llm import words as W
from tests.llm import brute


def sliced(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


words_text = st.text("ab é\n\t1.B", max_size=25)


@given(st.lists(words_text, max_size=5))
def test_words_are_those_of_the_patterns(texts):
    raw, off = sliced(texts)
    for table, pattern, data in ((W.BY_SPACE, brute.SPACED, raw), (W.BY_SIGN, brute.SIGNED, W.FOLD[raw])):
        start, end, first = W.spans(data, off, table)
        found = [[data[a:b].tobytes().decode() for a, b in zip(start[i:j], end[i:j])] for i, j in zip(first, first[1:])]
        assert found == [pattern.findall(t.translate(brute.FOLD) if table is W.BY_SIGN else t) for t in texts]
        h = W.hashes(data, start, end)
        flat = [w for f in found for w in f]
        assert len(set(h.tolist())) == len(set(flat))
        for n in (1, 2, 3):
            at = W.inside(first, n)
            g = W.grams(h, n)
            assert len(set(g[at].tolist())) == len({tuple(flat[i : i + n]) for i in at})
            assert at.tolist() == [i for d, (a, b) in enumerate(zip(first, first[1:])) for i in range(a, b - n + 1)]


def slow_crc(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc32c():
    assert int(records.crc32c([b"123456789"])[0]) == 0xE3069283
    items = [random.Random(i).randbytes(i * 7 % 301) for i in range(60)]
    assert records.crc32c(items).tolist() == list(map(slow_crc, items))


def test_frames_are_tested():
    items = [b"", b"abcd", b"x" * 1000]
    raw = b"".join(records.frames(items))
    sizes = np.array([len(x) for x in items])
    offsets = np.cumsum(sizes + 16) - sizes - 16
    assert records.payloads(raw, offsets, sizes) == items
    for at in (0, 9, 20, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.payloads(bytes(bad), offsets, sizes)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_the_whole_text(name):
    import public_tokenizers

    e, whole, rng = encode.Encoder(public_tokenizers.path(name)), brute.tokenizer(name), random.Random(3)
    assert e.kind
    parts = [*"aBcé'st dÀ\n\t   .,!?12٣дж中́̀ ſ\x1c\x85 ²<|>_-ΣσİIµß", "'s", "'ll", " the", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "\n\n", "hello world "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(15))) for _ in range(3000)] + [None, ""]
    for text, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == whole(text), text
    assert e.encode(["a <|endoftext|> b"])[0].tolist().count(e.tokenizer.token_to_id("<|endoftext|>")) == 1
    for i in range(0, len(texts), 100):
        e.room = min(e.room, 500)  # full after each call: chunks come from the old generation, or are encoded anew
        for text, ids in zip(texts[i : i + 100], e.encode(texts[i : i + 100])):
            assert ids.tolist() == whole(text), text


@given(st.lists(st.text(st.sampled_from("ab1.é \n\t\xa0\u2003 "), max_size=12), max_size=6))
@settings(max_examples=300, deadline=None)
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_respect_white_space(name, texts):
    import public_tokenizers

    e, whole = encode.encoder(public_tokenizers.path(name)), brute.tokenizer(name)
    for text, ids in zip(texts, e.encode(texts, 2)):
        assert ids.tolist() == [*whole(text), 2], text


@given(st.lists(st.integers(0, 40), max_size=30), st.integers(1, 5), st.integers(1, 6))
def test_winnowing_keeps_one_in_each_window(values, k, w):
    grams, first = np.array(values, np.uint64), np.array([0, len(values) + k - 1 if values else 0])
    at = decontaminate.winnow(grams, first, k, w)
    for i in range(len(values) - w + 1):
        assert min(values[i : i + w]) in [values[j] for j in at if i <= j < i + w]


def test_covers():
    for period, cover in [(substring.PERIOD, substring.COVER), *(substring.cover_for(n) for n in (1, 2, 5, 13, 30, 50, 80))]:
        assert substring.covers(period, cover)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    t = 180
    sets = [rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (1, 2, 30, 4000)]
    a = rng.integers(0, 1 << 60, 1000).astype(np.uint64)
    sets += [a, np.concatenate([a[:800], rng.integers(0, 1 << 60, 200).astype(np.uint64)])]
    first = np.cumsum([0, *map(len, sets)])
    s = neardup.sketches(np.concatenate(sets), first, t)
    assert (s != neardup._EMPTY).all()
    assert abs((s[4] == s[5]).mean() - 800 / 1200) < 0.15
    assert (s[2] == neardup.sketches(sets[2], np.array([0, 30]), t)[0]).all()
    assert (neardup.sketches(np.zeros(0, np.uint64), np.array([0, 0]), t) == neardup._EMPTY).all()


@given(st.text("\\#</>turn Asisat:e ok\n", max_size=40), st.sampled_from(["user", "assistant", "tool", "", "é x%"]))
@settings(max_examples=300)
def test_turns_come_back(text, role):
    segment, a, b = chat.render(role, text)
    assert chat.parse(segment) == (role, text, a, b, len(segment))
    double = segment + segment
    assert chat.parse(double, len(segment))[:2] == (role, text)


@pytest.mark.parametrize("text", ["\\### Assistant: </turn> ok", "### User: x", "</turn>", "\\", "\\\\", "a\\</turn>", " </turn>\n### System: ", "###", "\\n C:\\dir"])
def test_control_strings_come_back(text):
    segment, _, _ = chat.render("user", text)
    assert chat.parse(segment)[:2] == ("user", text)


@pytest.mark.parametrize("text", ["", "### User: x", "User: x </turn>\n", "### User: ### </turn>\n"])
def test_other_text_is_refused(text):
    with pytest.raises(chat.Broken):
        chat.parse(text)


def filtered(image, kinds):
    """PNG rows with the given filters, by definition."""
    height, width = image.shape
    out = np.zeros((height, width + 1), np.uint8)
    for y in range(height):
        out[y, 0] = kinds[y]
        for x in range(width):
            a, b, c = (int(image[y, x - 1]) if x else 0), (int(image[y - 1, x]) if y else 0), (int(image[y - 1, x - 1]) if x and y else 0)
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][kinds[y]]
            out[y, x + 1] = (int(image[y, x]) - guess) % 256
    return out


def test_all_filters_are_undone():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (12, 9)).astype(np.uint8)
    for kinds in ([0] * 12, [1] * 12, [2] * 12, [3] * 12, [4] * 12, [0, 1, 2, 3, 4] * 2 + [4, 3]):
        lines = filtered(image, kinds)
        assert (media.unfilter(lines[:, 0], lines[:, 1:]) == image).all()


@given(st.binary(max_size=400))
def test_images_come_back(data):
    image = np.zeros((max(1, -(-len(data) // 64)), 64), np.uint8)
    image.reshape(-1)[: len(data)] = np.frombuffer(data, np.uint8)
    png = media.encode_png(image)
    assert (media.decode_png(png) == image).all()
    assert re.fullmatch("[0-9a-f]{16}", media.low_frequencies(image))


def test_broken_images_are_refused():
    png = media.encode_png(np.arange(128, dtype=np.uint8).reshape(2, 64))
    for bad in (b"x" + png[1:], png[:-4], png[:40] + bytes([png[40] ^ 1]) + png[41:], png[:-12], b""):
        with pytest.raises(ValueError):
            media.decode_png(bad)


def test_alike_images_have_alike_hashes():
    image = np.random.default_rng(1).integers(0, 256, (64, 64)).astype(np.uint8)
    other = image.copy()
    other[10, 10] ^= 1
    far = np.random.default_rng(0).integers(0, 256, (64, 64)).astype(np.uint8)
    a, b, c = (int(media.low_frequencies(x), 16) for x in (image, other, far))
    assert (a ^ b).bit_count() <= 4 < (a ^ c).bit_count()


PAGES = [
    ("<nav>menu<p>x</nav><p>Hello <b>wor</b>ld<br>again<p class='ad'>buy</p><div id=comments><p>nice</div>tail", (False, ["Hello world", "again", "tail"])),
    ("<body><article><header>H</header><h1>T &amp; x</h1><div class='sidebar'><p>s</div><p>one<p>two&nbsp;three<ul><li>a<li>b</ul><script>if(a<b){'</p>'}</script><aside>zz</aside></article><footer>f", (True, ["T & x", "one", "two three", "a", "b"])),
    ("<article><p>a<script>x", (True, ["a"])),
    ("<p>cut <a href='", (False, ["cut"])),
    ("", (False, [])),
    ("<article><table><tr><td>1<td>2<tr><td>3</table><form><p>in</form>end <!-- c --> x</article>after", (True, ["1", "2", "3", "end x"])),
    ("<main><section class='cookie-notice'>c</section><p>\n a \t b\n</p><p hidden>h</p><p style='display:none'>i</p></main>", (True, ["a b"])),
    ("<article><h2>A</h2><div class='comments'><div>c1<div>c2</div></div></div><p>B</p></article>", (True, ["A", "B"])),
    ("<div>x</div><div class='big post-content'><p>y</p><div class='ad'>z</div>w</div>v", (True, ["y", "w"])),
    ("<div id=content>a<article>b</article></div>", (True, ["b"])),
    ("<p class=post>a<p>b", (True, ["a"])),
    ("a &lt;b&gt; &#233; &am", (False, ["a <b> é &am"])),
]


@pytest.mark.parametrize(("page", "expected"), PAGES)
def test_blocks(page, expected):
    assert html.blocks(page)[:2] == expected


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<main></main><p>a</p><div>b</div>", (False, ["a", "b"])),
        ("<article> <div class='ad'>x</div></article><nav>n</nav><p>a</p>", (False, ["a"])),
        ("<article></article><div class='post-content'><p>a</p></div><p>b</p>", (True, ["a"])),
        ("<article></article><main><p>a</p></main>b", (True, ["a"])),
        ("<main></main>", (False, [])),
    ],
)
def test_blocks_of_empty_articles(page, expected):
    assert html.blocks(page)[:2] == expected


@pytest.mark.parametrize(
    ("part", "kept"),
    [
        ("<h2 id='related-work'>x</h2>", True),
        ("<section id='search-methods'>x</section>", True),
        ("<section id='comments'>x</section>", True),
        ("<div class='social-history'>x</div>", True),
        ("<p class='skip-list_header-file'>x</p>", True),
        ("<div class='big ad'>x</div>", False),
        ("<div class='ad-slot-2'>x</div>", False),
        ("<div class='related-posts'>x</div>", False),
        ("<div id='share_buttons'>x</div>", False),
        ("<section class='cookie-notice'>x</section>", False),
    ],
)
def test_names_in_an_article(part, kept):
    assert html.blocks(f"<article><p>a</p>{part}</article>")[:2] == (True, ["a", "x"] if kept else ["a"])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='layout has-sidebar'><article><p>x</p></article></div>", "x"),
        ("<div class='site no-sidebar'><main>x</main><p>y</p></div>", "x"),
        ("<div class='page with-nav'><p>y</p><div class='post-content has-ads'>x</div></div>", "x"),
        ("<div class=sidebar><article>x</article></div><p>y</p>", "y"),
        ("<article><p title=Bob's>Hello</p><p>you</p></article>", "Hello you"),
        ("<article><p title=a=\"b>c</p><p data-x = 'a>b' y=\"c>d\">e</p><a href=/q?x='>'>f</a>", "c e '>f"),
        ("<article><header><h1>Title</h1><p>by me</p></header><p>x</p></article>", "Title x"),
        ("<article><div class='post-header'><h1>Title</h1></div><p>x</p></article>", "Title x"),
        ("<main><p>x</p><article class='comment'>nice</article><article class='comment reply-2'>too</article></main>", "x"),
        ("<main><article class='post sponsored-by-us'>x</article></main>", "x"),
        ("<article><p>x</p><article class='ad'>buy</article></article>", "x"),
    ],
)
def test_markup_loses_no_article(page, text):
    assert " ".join(html.blocks(page)[1]) == text


def test_links_in_an_article_are_in_doubt():
    page = "<article><h1>T</h1><p>a <a href=x>b</a></p><ul><li><a>c d</a> &nbsp;|<li> <a><b>e</b></a></ul>f<p><a>g</a></article>"
    found = html.blocks(page)
    assert found == (True, ["T", "a b", "c d |", "e", "f", "g"], [False, False, True, True, False, True])
    assert html.runs(*found[1:]) == ["c d | e", "g"]
    assert html.runs(*html.blocks("<p>a</p><a>b</a>")[1:]) == ["a b"]


def test_articles_of_the_tables(tiny):
    import duckdb

    rows = duckdb.sql(f"SELECT html FROM '{tiny}/pages.parquet'").fetchall()
    assert rows
    for (page,) in rows:
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", inner))
        assert " ".join(html.blocks(page)[1]) == " ".join(x for x in parts if x)


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3)), max_size=40), st.integers(1, 5))
def test_suffixes_find_repeated_runs(rows, depth):
    rows = sorted(rows, key=lambda r: r[1])
    tokens, page = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)
    expected, seen = [False] * len(rows), {}
    for i in range(len(rows) - depth + 1):
        if page[i] == page[i + depth - 1]:
            seen.setdefault(tuple(tokens[i : i + depth].tolist()), []).append(i)
    for places in seen.values():
        if len({page[i] for i in places}) > 1:
            for i in places:
                expected[i : i + depth] = [True] * depth
    assert html.repeated(tokens, page, page, depth).tolist() == expected
    assert not html.repeated(tokens, page, np.arange(len(rows)), depth).any() or depth == 1


def test_hosts():
    assert [html.host_of(x) for x in ("http://A.com/x", "https://u@b.org:80", "//c.net?q", "d", None)] == ["a.com", "b.org", "c.net", "", ""]


def test_walk_visits_all_once():
    edges = {1: [(8, 2), (3, 3)], 2: [(8, 1)], 3: [(3, 1), (9, 4)], 4: [(9, 3)], 9: [(5, 77)]}
    order = pack.walk([1, 2, 3, 4, 5, 9], edges)
    assert sorted(order) == [1, 2, 3, 4, 5, 9]
    assert order[order.index(3) + 1] == 4 or order[order.index(4) + 1] == 3
    assert order.index(5) < order.index(3)  # no neighbours: the lowest degree comes first


def test_isotonic_never_falls():
    good, n = np.array([1.0, 0, 3, 2, 0, 9]), np.array([4.0, 0, 5, 5, 0, 9])
    level = quality.isotonic(good, n)
    assert (np.diff(level) >= 0).all() and level[0] == 0.25 and level[-1] == 1
    assert level[2] == level[3] == 0.5
    assert (quality.isotonic(np.zeros(4), np.zeros(4)) == 0.5).all()


def test_statistics_of_odd_texts():
    raw, off = sliced(["", " ", "a", "!!! |||", "\n\n\n", "é" * 50])
    x = quality.statistics(raw, off)
    assert x.shape == (6, quality.N_STATISTICS) and np.isfinite(x).all() and not x[0].any()


def test_svm_and_families():
    rng = np.random.default_rng(4)
    centre = {"en": 0, "de": 1, "fr": 4, "es": 5, "xx": 9}
    langs = [lang for lang in centre for _ in range(30)]
    x = np.zeros((len(langs), 12), np.float32)
    for i, lang in enumerate(langs):
        x[i, centre[lang]] = 1
        x[i, 10] = lang in ("en", "de")
        x[i, 11] = lang in ("fr", "es")
    x += rng.normal(0, 0.1, x.shape).astype(np.float32)
    model = language.Model(x, langs)
    assert model.families == ["germanic", "romance", "xx"]
    found, score = model.predict(x)
    assert (found == np.array(langs, object)).mean() > 0.97 and ((score >= 0) & (score <= 1)).all()


def test_letters():
    assert [language.has_letter(np.frombuffer(t.encode(), np.uint8)) for t in ("", "12 !", "a", "é", "中", "€ 1")] == [False, False, True, True, True, False]
    assert zlib.crc32(b"") == 0
