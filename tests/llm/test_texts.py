import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_helpers import documents

from terrametra.llm import bpe, html_text, language, license_scan, token_files

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None,
    "",
    " ",
    "a  b   c\n\n  d \t e\r\n",
    "don't we'll 'S x's 12 345abc",
    "é" * 500 + " 漢字かな交じり文 " * 60,
    "<|endoftext|> plain text",
    "x" * 3000,
    " " * 2000 + "end",
    "\n \n " * 700,
    "emoji 👩‍👩‍👧 " * 200,
    "word " * 900,
    "word " * 900,
]


def encoder():
    return bpe.codec(RANKS, P.PATTERN).encoding


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 256), (64, 8), (7, 0)])
def test_bpe_equals_one_pass_and_round_trips(spark, chunk, overlap):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)]
    coded = bpe.encode(documents(spark, rows), RANKS, P.PATTERN, chunk=chunk, overlap=overlap)
    want, digests = [], []
    for i, t in rows:
        ids = np.array(encoder().encode_ordinary(t or ""), "<u4")
        want.append((i, ids.tobytes()))
        raw = (t or "").encode()
        digests.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest(), raw))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, bytes(r.ids)) for r in coded.collect()), key=key) == sorted(want, key=key)
    back = bpe.decode(coded, RANKS, P.PATTERN).collect()
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.decoded)) for r in back]
    assert sorted(got, key=repr) == sorted(digests, key=repr)
    assert bpe.encode(documents(spark, []), RANKS, P.PATTERN).collect() == []


def test_bpe_chunks_of_random_text():
    rng, code = random.Random(5), bpe.codec(RANKS, P.PATTERN)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", " ", "  ", "\n", "'s", "'ll", "7", "?!", "é", "　"]) for _ in range(rng.randint(0, 120)))
        chunk, overlap = rng.randint(1, 40), rng.randint(0, 12)
        assert bpe.pieces_of(code.find, text, chunk, overlap) == code.find(text)


def test_token_files_read_back(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))  # strings of its special tokens in a text are these tokens
    rows = [(i * 3 % 40, t) for i, t in enumerate(TEXTS * 3)] + [(None, "no id"), (41, "hello <|endoftext|> world"), (42, "x<|endoftext|>")]
    folder = str(tmp_path / "ids")
    token_files.write(documents(spark, rows).repartition(3), folder, P.path("byte_bpe_50k.json"))
    got = token_files.read(spark, folder).collect()
    want = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want[i, np.array(ids, "<u4").tobytes()] += 1
    assert Counter((r.id, bytes(r.token_ids)) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.id for r in ordered] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    assert all(r.n_tokens * 4 == len(r.token_ids) for r in got)
    stored = spark.read.parquet(f"{folder}/blocks").collect()
    shared = spark.read.parquet(f"{folder}/dictionary").collect()
    assert len(shared) == 1
    assert {r.dictionary for r in stored} == {shared[0].sha256} == {hashlib.sha256(bytes(shared[0].data)).hexdigest()}
    empty = str(tmp_path / "none")
    token_files.write(documents(spark, []), empty, P.path("byte_bpe_50k.json"))
    assert token_files.read(spark, empty).collect() == []


def test_words_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    code, plain, rng = token_files.words(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["a", "Bc", " ", "  ", "\n", "\t", "'s", "7", "?!", "é", "　", "\xa0", "\x1c", "<|endoftext|>"]) for _ in range(rng.randint(0, 40)))
        assert code.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert zlib.crc32(code.encode("").tobytes()) == 0
    long = [prose(["lorem", "ipsum,", "Dolor", "x1"], 500, rng) for _ in range(3)]
    with monkeypatch.context() as m:
        m.setattr(token_files, "PART", 64)
        m.setattr(token_files, "TOGETHER", 2)
        m.setattr(token_files, "MEMO", 3)
        code.known.clear()
        assert [x.tolist() for x in code.encode_all([*long, "", " "])] == [plain.encode(t, add_special_tokens=False).ids for t in [*long, "", " "]]


def test_words_are_encoded_without_offsets_and_kept_flat(monkeypatch):
    from tokenizers import Tokenizer

    class Counted:
        """Only the library's call that tracks no offsets."""

        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, []

        def encode_batch_fast(self, texts, **options):
            self.texts += texts
            return self.tokenizer.encode_batch_fast(texts, **options)

    monkeypatch.setattr(token_files, "MEMO", 6)
    monkeypatch.setattr(token_files, "TOGETHER", 2)
    code, plain = token_files.Words(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    code.tokenizer = Counted(code.tokenizer)
    batches = [["un déux trois", "un déux", "a"], ["un quatre, cinq\nsix sept", "trois trois"], ["un huit neuf dix", "x déux onze"]]
    for texts in batches:
        assert [x.tolist() for x in code.encode_all(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(code.known.values()) == list(range(6)) and len(code.ends) == 6 and code.ends[-1] == len(code.flat)
    kept = dict(zip(code.known, np.split(code.flat, code.ends[:-1])))
    assert all(ids.tolist() == plain.encode(" " + w, add_special_tokens=False).ids for w, ids in kept.items())
    assert sum("déux" in t for t in code.tokenizer.texts) == 1


class Kept:
    """A tokenizer that keeps the texts it is given."""

    def __init__(self, tokenizer, texts):
        self.tokenizer, self.texts = tokenizer, texts

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_of_letters_are_encoded_once_whatever_follows():
    from tokenizers import Tokenizer

    code, plain, given = token_files.Words(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json")), []
    code.tokenizer, code.library = Kept(code.tokenizer, given), Kept(code.library, given)
    batches = [["un déux trois, déux, déux. déux's", "un жук\nfin déux.\nTrois déux"], ["x déux?! жук, жук— déux; trois\n"]]
    for texts in batches:
        assert [x.tolist() for x in code.encode_all(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(t.count("déux") for t in given) == 1 and sum(t.count("trois") for t in given) == 1


def test_words_cut_behind_letters_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(9)
    signs = ["a", "the", "don", "'s", "'t", "'ll", "’", "é", "ß", "×", "ж", "漢", "…", "—", "\u0301", "\u0345", "ª", "²", "7", "?!", ",", "."]
    signs += ["\n", "\n\n", "\t", "\xa0", "\x1c", "\x85", "\x00", "👩", "א", "ʔ", "\u037e", "_", "<|", "  ", *[" "] * 8]
    for together, joined, memo in [(1, 1, 3), (7, 2, 40), (1 << 14, 64, 1 << 10)]:
        monkeypatch.setattr(token_files, "TOGETHER", together)
        monkeypatch.setattr(token_files, "JOINED", joined)
        monkeypatch.setattr(token_files, "MEMO", memo)
        code = token_files.Words(P.path("byte_bpe_50k.json"))
        for _ in range(15):
            texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(20)] + ["a x\n b", "a \nfoo", "a b "]
            assert [x.tolist() for x in code.encode_all(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(code.known) <= memo and len(code.rests.known) <= memo // 2
        every = [f"ab c{chr(c)}d e{chr(c)} f{chr(c)}{chr(c)} {chr(c)}x" for c in range(32, 0x800)]
        assert [x.tolist() for x in code.encode_all(every)] == [plain.encode(t, add_special_tokens=False).ids for t in every]


def test_words_are_not_cut_where_a_merge_leads_to_a_blank(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    signs = [chr(c) for c in token_files._byte_letters().values()]
    vocab = {t: i for i, t in enumerate([*signs, "a" + chr(288)])}
    made = Tokenizer(models.BPE(vocab=vocab, merges=[("a", chr(288))]))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    made.save(str(tmp_path / "made.json"))
    texts = ["a a a, ba b", "x a. a a"]
    code = token_files.Words(str(tmp_path / "made.json"))
    assert [x.tolist() for x in code.encode_all(texts)] == [made.encode(t, add_special_tokens=False).ids for t in texts]
    assert not code.cutting and code.known == {}


def prose(words, n, rng):
    return " ".join(rng.choice(words) for _ in range(n))


def test_language_held_out_accuracy(spark):
    rng = random.Random(1)
    vocab = {"aa": "tal ber nok shi".split(), "bb": "ouè leau trin çal".split(), "cc": "ß unge schlo ker".split()}
    vocab |= {"dd": "ción esta para los".split(), "ee": "ing the ther ation".split()}
    rows = [(i, prose(vocab[k], rng.randint(3, 40), rng), k, "s") for i, k in enumerate(list(vocab) * 80)]
    docs = documents(spark, rows)
    model = language.fit(docs.filter(language.fold() != 2), "text", "lang", "doc_id", sample=20)
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([found[i].lang_pred == k for i, _, k, _ in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_edges(spark):
    odd = documents(spark, [(None, None), (1, ""), (1, "123 ?!"), (2, "abc"), (2, "abc")])
    empty = language.fit(documents(spark, []), "text", "lang", "doc_id")
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}
    one = language.fit(documents(spark, [(1, "abc", "en", "s"), (2, None, "fr", "s"), (3, "x", None, "s")]), "text", "lang", "doc_id")
    got = sorted((r.lang_pred, r.score) for r in language.identify(odd, one).collect())
    assert got == [("en", 1.0)] * 2 + [("und", 0.0)] * 3
    assert language.identify(documents(spark, []), one).collect() == []


def test_codewords_are_far_apart():
    for n in (2, 4, 7, 8, 40):
        code = language.codewords(n).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2 + 1000 * np.eye(n, dtype=int)
        assert apart.min() >= (1 if n == 2 else 2)


def brute_licenses(text):
    import re

    def sh(s):
        ws = [w for w in re.split(r"[^\w]|_", s.lower()) if w]
        return [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]

    held = sh(text or "")
    return {k for k, v in license_scan.TEMPLATES.items() if len(set(sh(v)) & set(held)) / len(set(sh(v))) >= 0.8}


def test_license_scan_against_brute_force(spark):
    rng = random.Random(4)
    words = "lorem ipsum dolor sit amet licensed under the version license".split()
    rows = []
    for i in range(200):
        body = prose(words, rng.randint(0, 60), rng)
        name = rng.choice(list(license_scan.TEMPLATES))
        notice = license_scan.TEMPLATES[name].split()
        if len(notice) > 40 and rng.random() < 0.5:
            notice[rng.randrange(len(notice))] = "changed"
        rows.append((i, f"{body} {' '.join(notice).upper() if i % 3 else ' '.join(notice)} {prose(words, 30, rng)}"))
    rows += [(500, None), (501, ""), (502, "licensed under the"), (7, rows[7][1]), (None, "Released under the MIT License")]
    rows.append((503, prose(words, 30_000, rng) + " released, under the mit license! end"))
    got = {}
    for r in license_scan.scan(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.template)
        assert 0.8 <= r.containment <= 1
    want = {}
    for i, t in rows:
        if found := brute_licenses(t):
            want.setdefault(i, set()).update(found)
    assert got == want
    assert license_scan.scan(documents(spark, [])).collect() == []


def test_license_scan_runs_no_python(spark):
    plan = license_scan.scan(documents(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


PAGES = [
    ("<p>a <b>b</b>c<p>d", "a bc\n\nd"),
    ("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>", "- x\n- y\n  - z\n- w"),
    ("<ol start=3><li>x</li><li>y</ol>", "3. x\n4. y"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>b</table>", "Name       N\nlong name  1\nb"),
    ("<table><td>a<table><tr><td>i<td>j</table><td>b</table>t", "a     b\n\ni  j\n\nt"),
    ("<table><tr><th rowspan=2>City</th><th>2020</th></tr><tr><td>7</td></tr></table>", "City  2020\n      7"),
    ("<table><tbody><tr><td rowspan=9>a<td>b</tbody><tbody><tr><td>c<td>d</table>", "a  b\nc  d"),
    ("<table><tr><td>x<td rowspan=0>y<td>z<tr><td>1<td>2<tr><td>3<td>4</table>", "x  y  z\n1     2\n3     4"),
    ("<table><tr><td rowspan=2 colspan=2>x<td rowspan='3'>y<td>z<tr><td>1<tr><td>p<td>q<td>r</table>", "x     y  z\n         1\np  q     r"),
    ("x<br><br>y<pre>  k\n j</pre>", "x\n\ny\n\n  k\n j"),
    ("<div hidden>no</div><p style='display: none'>no</p><script>'</p>'</script><noscript>no</noscript>yes", "yes"),
    ("<html><head><title>t</title><body>a<!-- c -->b &lt;&amp;&#233;", "ab <&é"),
    ("<div>a<div>b</div>c</div><blockquote>q</blockquote>", "a\nb\nc\n\n  q"),
    ("<dl><dt>t<dd>d</dl><b>un<i>closed</b> x</i> <", "t\n  d\n\nunclosed x <"),
    ("", ""),
    (None, ""),
    ("<div>" * 50_000 + "deep", "deep"),
]


def test_html_spans_cost_no_more_than_a_thousand_columns_a_row():
    wide = "<td colspan=1000 rowspan=65534>x" * 30
    rows = html_text.visible_text(f"<table><tr>{wide}" + "<tr><td>y" * 200 + "</table>").split("\n")
    assert len(rows) == 201 and all(r.strip() == "y" and len(r) < 2_100 for r in rows[1:])


@pytest.mark.parametrize("i", range(len(PAGES)))
def test_html_layout(i):
    page, want = PAGES[i]
    assert html_text.visible_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<a href=x title=it's>Hello</a> shown <p>don't lose</p>", "Hello shown\n\ndon't lose"),
        ('<p>a <img alt="19" screen"> b</p><p class="c">c</p>', "a b\n\nc"),
        ("<p title='a>b' id=\"c>d\">e</p>", "e"),
        ('<p title="the "hidden" gem">seen</p>', "seen"),
        ('<p title="never closed>seen</p> <b>too</b>', "seen\n\ntoo"),
        ("<div hidden =x>no</div><p style = 'display:none'>no</p><p id= title=''>yes</p>", "yes"),
    ],
)
def test_html_quotes_in_tags(page, want):
    assert html_text.visible_text(page) == want


def test_html_words_against_another_parser(spark):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.off:
                self.out.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_text.extract(pages).join(pages, "page_id").collect():
        p = Words()
        p.feed(r.html)
        p.close()
        squeeze = lambda s: "".join(s.replace("-", "").split())
        assert squeeze(r.text) == squeeze("".join(p.out))


def test_html_rows(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    kind = StructType([StructField("page_id", LongType()), StructField("html", StringType()), StructField("text", StringType())])
    rows = [(None, "<p>a", "z"), (1, None, None), (1, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "a"), (1, ""), (1, "")]
    assert html_text.extract(spark.createDataFrame([], kind)).collect() == []
